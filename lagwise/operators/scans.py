"""Lagged features of entities too large for one task: segmented scans.

An entity's rows get their places in its order without being brought together: rows are
numbered within a grain of time (a day, say), and only the grains' counts are summed along
the entity. Places cut the entity into blocks of equal size. What reaches over a
block's start is either the few rows before it, which go along to the next block as a
halo, or a carry: a sum, a largest place, a decayed sum and its weight. Carries of blocks are
composed along the entity, one row a block, and joined back. So no task holds more than a
grain or a block, however many rows an entity has.

The features equal those of windows and ewma. Those take one shuffle for entities of
ordinary size; these take three or four. A null key is a key like any other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ewma import keep_of, reach

#: Rows of a block.
SIZE = 65_536


@dataclass(frozen=True)
class Segments:
    """Rows with _i, their place in their entity from 0."""

    df: DataFrame
    keys: tuple[str, ...]
    size: int = SIZE

    def with_rows(self, df: DataFrame) -> Segments:
        return Segments(df, self.keys, self.size)

    def result(self) -> DataFrame:
        return self.df.drop("_i")


def _met(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """df joined to side by the columns on, nulls equal to each other."""
    other = side.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return df.join(other, same, how).drop(*[f"_on_{c}" for c in on])


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], grain: Column | str, size: int = SIZE) -> Segments:
    """df with each row's place in its entity's order, which must be total.

    grain is a coarser form of order's first column (its date, month or hour; the column
    itself will do) that never goes down along the order. A task holds one grain of one
    entity at a time, so choose it fine enough for the busiest entity. Nulls in order come first."""
    if not order:
        raise ValueError("an order is needed; without one, places have no meaning")
    grained = df.withColumn("_g", F.col(grain) if isinstance(grain, str) else grain)
    counts = grained.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "_g", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*keys, "_g").orderBy(*order)) - 1
    out = _met(grained.withColumn("_own", own), base, [*keys, "_g"], "inner")
    return Segments(out.withColumn("_i", F.col("_base") + F.col("_own")).drop("_g", "_own", "_base"), tuple(keys), size)


def halo(seg: Segments, rows: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> Segments:
    """seg plus columns, each a function of a window that reaches back over at most so many
    rows. The last rows of each block go along to the next, so one shuffle by block serves all."""
    if not 0 <= rows <= seg.size:
        raise ValueError(f"a window of {rows} rows reaches over more than a block of {seg.size}")
    block, late = F.floor(F.col("_i") / seg.size), F.col("_i") % seg.size >= seg.size - rows
    dealt = seg.df.withColumn("_b", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    over = Window.partitionBy(*seg.keys, "_b").orderBy("_i")
    out = dealt.withColumns({name: f(over) for name, f in columns.items()})
    return seg.with_rows(out.where(F.col("_b") == block).drop("_b"))


def rolling_mean(value: str, n: int) -> Callable[[WindowSpec], Column]:
    """For halo(): the mean of up to n earlier rows; null before the first."""
    return lambda over: F.avg(value).over(over.rowsBetween(-n, -1))


def rolling_sum(value: str, n: int) -> Callable[[WindowSpec], Column]:
    return lambda over: F.sum(value).over(over.rowsBetween(-n, -1))


def ratio_of_sums(num: str, den: str, n: int, scale: float = 100.0, default: float = 100.0) -> Callable[[WindowSpec], Column]:
    """For halo(): scale * sum(num) / sum(den) over up to n earlier rows, else default."""
    sums = lambda over: F.try_divide(F.sum(num).over(over.rowsBetween(-n, -1)), F.sum(den).over(over.rowsBetween(-n, -1)))
    return lambda over: F.coalesce(sums(over) * scale, F.lit(default))


def lagged(value: str, k: int = 1) -> Callable[[WindowSpec], Column]:
    """For halo(): the value k rows before."""
    return lambda over: F.lag(value, k).over(over)


def running(seg: Segments, columns: dict[str, tuple[Column, Callable]]) -> Segments:
    """seg plus columns, each a value and an associative aggregate (F.sum, F.max, F.min) of it
    over all rows up to its own: the block's running one and the carry of all blocks before."""
    names = list(columns)
    block = F.floor(F.col("_i") / seg.size)
    df = seg.df.withColumns({"_b": block, **{f"_v{k}": columns[n][0] for k, n in enumerate(names)}})
    ends = df.groupBy(*seg.keys, "_b").agg(*[columns[n][1](f"_v{k}").alias(f"_e{k}") for k, n in enumerate(names)])
    before = Window.partitionBy(*seg.keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*seg.keys, "_b", *[columns[n][1](f"_e{k}").over(before).alias(f"_c{k}") for k, n in enumerate(names)])
    own = Window.partitionBy(*seg.keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = _met(df.withColumns({f"_o{k}": columns[n][1](f"_v{k}").over(own) for k, n in enumerate(names)}), carry, [*seg.keys, "_b"])
    join = {F.sum: lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), F.max: F.greatest, F.min: F.least}
    out = out.withColumns({n: join[columns[n][1]](F.col(f"_o{k}"), F.col(f"_c{k}")) for k, n in enumerate(names)})
    return seg.with_rows(out.drop("_b", *[f"_{x}{k}" for k in range(len(names)) for x in "voc"]))


def runs(seg: Segments, flag: str, run_id: str = "run_id", run_length: str = "run_length") -> Segments:
    """seg plus the number of the row's run of equal flags, from 1, and its place in the
    run, 0 where the flag is 0. A null flag begins no run of its own after another row's,
    as in windows.run_id: what differs from null isn't known."""
    seg = halo(seg, 1, {"_was": lagged(flag)})
    begins = (F.col("_was").isNull() | (F.col("_was") != F.col(flag))) & F.lit(True)
    begins = F.coalesce(begins, F.lit(False))
    seg = running(seg, {run_id: (F.when(begins, 1).otherwise(0), F.sum), "_first": (F.when(begins, F.col("_i")), F.max)})
    place = F.when(F.col(flag) == 0, 0).otherwise((F.col("_i") - F.col("_first") + 1).cast("int"))
    return seg.with_rows(seg.df.withColumn(run_length, place).drop("_was", "_first"))


def ewma(seg: Segments, columns: dict[str, str], span: float | None = None, halflife: float | None = None, adjust: bool = False) -> Segments:
    """seg plus, for each new name in columns, the exponentially weighted mean of its
    column's earlier rows.

    A block is as long as it takes a weight to fall under 1e-17, so the carry into a block
    is the decayed sum, and weight, of the block before alone. adjust=True divides by the
    sum of weights, and null rows then only age the others'; adjust=False starts from the
    first value, and a null is an error."""
    q = keep_of(span, halflife)
    n = reach(q)
    block, o = F.floor(F.col("_i") / n), F.col("_i") % n
    df = seg.df.withColumns({"_b": block, "_o": o})
    parts: dict[str, Column] = {}
    for k, c in enumerate(columns.values()):
        x = F.col(c).cast("double")
        if adjust:
            parts[f"_x{k}"], parts[f"_w{k}"] = F.coalesce(x, F.lit(0.0)), F.when(x.isNull(), 0.0).otherwise(1.0)
        else:
            x = F.coalesce(x, F.raise_error(F.lit(f"{c} is null: take adjust=True")).cast("double"))
            parts[f"_x{k}"] = F.when(F.col("_i") == 0, x).otherwise(x * (1 - q))
    df = df.withColumns(parts)
    decay = lambda p: F.pow(F.lit(q), p)
    ends = df.groupBy(*seg.keys, "_b").agg(*[F.sum(F.col(p) * decay(n - 1 - F.col("_o"))).alias(f"_e{p}") for p in parts]).withColumn("_b", F.col("_b") + 1)
    own = Window.partitionBy(*seg.keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({f"_s{p}": F.sum(F.col(p) * decay(-F.col("_o"))).over(own) for p in parts})
    out = _met(out, ends, [*seg.keys, "_b"])
    total = {p: F.coalesce(F.col(f"_s{p}"), F.lit(0.0)) * decay(F.col("_o") - 1) + F.coalesce(F.col(f"_e{p}"), F.lit(0.0)) * decay(F.col("_o")) for p in parts}
    means = {name: F.try_divide(total[f"_x{k}"], total[f"_w{k}"]) if adjust else total[f"_x{k}"] for k, name in enumerate(columns)}
    out = out.withColumns({name: F.when(F.col("_i") > 0, m) for name, m in means.items()})
    return seg.with_rows(out.drop("_b", "_o", *parts, *[f"_{x}{p}" for p in parts for x in "se"]))
