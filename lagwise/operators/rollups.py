"""Members to groups: roster roll-ups, shares, weighted means, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The greatest of structs of one field is that of the field, and makes Spark sum in order of
# the keys: a hash table would hold dozens of numbers for each of a task's many small groups.
_FUNCTIONS = {"sum": F.sum, "std": F.stddev_samp, "max": lambda c: F.max(F.struct(F.col(c).alias("x")))["x"], "mean": F.avg}


def roster_rollup(df: DataFrame, keys: Sequence[str], wanted: dict[str, Sequence[str]], fill_std: Sequence[str] = ()) -> DataFrame:
    """<function>_<column> of each group, in one aggregation. The std of one member is
    null, and 0 for the columns in fill_std."""
    named = [_FUNCTIONS[f](c).alias(f"{f}_{c}") for c, fs in wanted.items() for f in fs]
    out = df.groupBy(*keys).agg(*named)
    return out.withColumns({f"std_{c}": F.coalesce(f"std_{c}", F.lit(0.0)) for c in fill_std})


def star_share(value: str) -> Column:
    """Aggregate: the largest member's part of the group's sum; 0 without a sum."""
    return F.coalesce(F.try_divide(F.max(value), F.sum(value)), F.lit(0.0))


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: sum of value times weight over sum of weights; 0 without weights."""
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(0.0))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same however the rows are partitioned; top-n by a hash of the key."""
    mixed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.orderBy(mixed, key).limit(n)


def top(df: DataFrame, value: str, n: int = 15, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(value).desc(), *ties).limit(n)


def combined_ranking(tables: dict[str, DataFrame], key: str = "feature", value: str = "importance") -> DataFrame:
    """Full outer join of importance tables by feature: one column per table."""
    out = None
    for name, t in tables.items():
        one = t.select(key, F.col(value).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    return out
