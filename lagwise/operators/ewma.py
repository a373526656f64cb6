"""Exponentially weighted means of earlier rows, without Python workers.

Two kernels. The block kernel takes time in proportion to the rows: a key's rows are
cut into blocks so long that what lies two blocks back weighs under 1e-17; within a
block a prefix sum of scaled values gives the mean, and the block before adds its
end. It is for columns without nulls and fails on one. The folding kernel
keeps nulls out of the mean but lets weights decay over them; it folds the last rows
of every row, at the cost of rows times block length."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import by


def keep_of(span: float | None = None, halflife: float | None = None) -> float:
    """What a weight is multiplied by from one row to the next."""
    if (span is None) == (halflife is None):
        raise ValueError("give either span or halflife")
    return 1 - 2 / (span + 1) if span is not None else 2 ** (-1 / halflife)


def reach(q: float) -> int:
    """Rows after which a weight is below 1e-17."""
    return math.ceil(math.log(1e-17) / math.log(q))


def _fitting(qs: Sequence[float]) -> list[list[float]]:
    """The decays in groups that can share blocks: within the longest block of a group no
    value is scaled beyond what a double holds."""
    out: list[list[float]] = []
    for q in sorted(set(qs), reverse=True):
        if out and -reach(out[-1][0]) * math.log10(q) < 250:
            out[-1].append(q)
        else:
            out.append([q])
    return out


def _means(df: DataFrame, wanted: dict[str, tuple[str | Column, float]], keys: Sequence[str], order: Sequence[str], adjust: bool, lag: int) -> DataFrame:
    """df plus, for each new name in wanted, the mean of its column by its decay. Decays
    that share blocks share one pass of windows. Places take one sort and the rest another,
    which is made before any value is: rows are sorted as narrow as they came."""
    out, whole = df, by(keys, order)
    for group in _fitting([q for _, q in wanted.values()]):
        n = reach(group[0])
        names = {name: w for name, w in wanted.items() if w[1] in group}
        along = by(keys, ["_block", *order])  # the order of whole
        out = out.withColumn("_block", F.floor((F.row_number().over(whole) - 1) / n)).withColumn("_i", F.row_number().over(along) - 1)
        out = out.withColumn("_o", F.col("_i") % n)
        block = by([*keys, "_block"], order).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
        own, ends, total = {}, {}, {}
        for k, (column, q) in enumerate(names.values()):
            named = F.col(column) if isinstance(column, str) else column
            x = F.coalesce(named.cast("double"), F.raise_error(F.lit(f"{list(names)[k]} is of a null: take ewma_with_nulls")).cast("double"))
            x = x if adjust else F.when(F.col("_i") == 0, x / (1 - q)).otherwise(x)
            own[f"_s{k}"] = F.sum(x * F.pow(F.lit(q), -F.col("_o"))).over(block) * F.pow(F.lit(q), F.col("_o"))
            ends[f"_e{k}"] = F.sum(F.when(F.col("_o") == n - 1, F.col(f"_s{k}"))).over(before)
            s = F.col(f"_s{k}") + F.coalesce(F.col(f"_e{k}"), F.lit(0.0)) * F.pow(F.lit(q), F.col("_o")) * q
            total[f"_t{k}"] = s * (1 - q) / (1 - F.pow(F.lit(q), F.col("_i") + 1)) if adjust else s * (1 - q)
        out = out.withColumns(own).withColumns(ends).withColumns(total)
        out = out.withColumns({name: F.lag(f"_t{k}", lag).over(along) if lag else F.col(f"_t{k}") for k, name in enumerate(names)})
        out = out.drop("_i", "_block", "_o", *own, *ends, *total)
    return out


def ewma(df: DataFrame, columns: dict[str, str | Column], keys: Sequence[str], order: Sequence[str], span: float | None = None,
         halflife: float | None = None, adjust: bool = False, lag: int = 1) -> DataFrame:
    """df plus, for each new name in columns, the mean of its column, or of a value made of
    the row's columns, as of `lag` rows before.

    adjust=False starts from the first value; adjust=True divides by the sum of weights.
    All columns share one pass; the key's shuffle is used for every window. A null in a
    column is an error."""
    q = keep_of(span, halflife)
    return _means(df, {name: (c, q) for name, c in columns.items()}, keys, order, adjust, lag)


def ewma_with_nulls(value: str, keys, order, span: float | None = None, halflife: float | None = None, adjust: bool = False):
    """Column: the mean of earlier rows by the folding kernel; null rows only age weights."""
    q = keep_of(span, halflife)
    alpha = 1 - q
    rows = F.collect_list(F.struct(F.col(value).cast("double").alias("x"))).over(by(keys, order).rowsBetween(-reach(q), -1))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("w"))

    def step(a, r):
        x, old = r["x"], a["w"] * q
        new = F.lit(1.0) if adjust else F.lit(alpha)
        mixed = F.when(a["y"].isNull(), x).otherwise((old * a["y"] + new * x) / (old + new))
        weight = F.when(a["y"].isNull(), F.lit(1.0)).otherwise(old + 1.0 if adjust else F.lit(1.0))
        return F.when(x.isNull(), F.struct(a["y"].alias("y"), old.alias("w"))).otherwise(F.struct(mixed.alias("y"), weight.alias("w")))

    return F.aggregate(rows, start, step)["y"]


def fan_out(df: DataFrame, columns: Sequence[str], keys, order, window: int = 8, spans: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """df plus, for each column, <c>_rolling_<window> and <c>_ewma_<span> of earlier rows."""
    over = by(keys, order).rowsBetween(-window, -1)
    out = df.withColumns({f"{c}_rolling_{window}": F.avg(c).over(over) for c in columns})
    wanted = {f"{c}_ewma_{s}": (c, keep_of(span=s)) for s in spans for c in columns}
    return _means(out, wanted, keys, order, adjust=False, lag=1)
