"""Lagged window features: a row's value comes from rows strictly before it.

All take keys (who), and order, which must put the rows of a key in one order: give
tie-breaking columns too. Functions return Columns, so that features of one key and
order share one shuffle and one sort when they stand in one select."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: Sequence[str], order: Sequence[str]):
    if not order:
        raise ValueError("an order is needed; without one, lagged features have no meaning")
    return Window.partitionBy(*keys).orderBy(*order)


def rolling_mean(value: str, n: int, keys, order) -> Column:
    """Mean of up to n earlier rows; null before the first."""
    return F.avg(value).over(by(keys, order).rowsBetween(-n, -1))


def rolling_sum(value: str, n: int, keys, order) -> Column:
    return F.sum(value).over(by(keys, order).rowsBetween(-n, -1))


def gap_days(date: str, keys, order, first: float = 5.0) -> Column:
    """Days since the key's row before; `first` for its first row."""
    return F.coalesce(F.date_diff(date, F.lag(date).over(by(keys, order))).cast("double"), F.lit(first))


def gap_flag(date: str, keys, order, days: int = 1) -> Column:
    """1 if the row before is exactly so many days back."""
    return F.when(F.date_diff(date, F.lag(date).over(by(keys, order))) == days, 1).otherwise(0)


def density_flag(date: str, keys, order, rows: int, days: int) -> Column:
    """1 if the row `rows` places before is at most `days` days back."""
    return F.when(F.date_diff(date, F.lag(date, rows).over(by(keys, order))) <= days, 1).otherwise(0)


def run_id(flag: str, keys, order) -> Column:
    """Counter per key that goes up when the flag changes; from 1."""
    was = F.lag(flag).over(by(keys, order))
    return F.sum(F.when(was.isNull() | (was != F.col(flag)), 1).otherwise(0)).over(
        by(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def run_length(df: DataFrame, flag: str, keys, order, name: str = "run_length") -> DataFrame:
    """df plus the row's place in its run of equal flags, 0 where the flag is 0."""
    runs = df.withColumn("_run", run_id(flag, keys, order))
    place = F.row_number().over(by([*keys, "_run"], order))
    return runs.withColumn(name, F.when(F.col(flag) == 0, 0).otherwise(place)).drop("_run")


def ratio_of_sums(num: str, den: str, n: int, keys, order, scale: float = 100.0, default: float = 100.0) -> Column:
    """scale * sum(num) / sum(den) over up to n earlier rows, else default."""
    over = by(keys, order).rowsBetween(-n, -1)
    return F.coalesce(F.try_divide(F.sum(num).over(over), F.sum(den).over(over)) * scale, F.lit(default))


def group_zscore(df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """df plus (x - mean) / sd of the row's group for each column; null becomes 0.

    Uses all rows of the group, later ones too. Groups are summed first and the few
    sums joined back, so a large group isn't brought together."""
    sums = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.join(sums, list(keys))
    scores = {f"{prefix}{c}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns}
    return out.withColumns(scores).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def expanding_zscore(value: str, keys, order) -> Column:
    """z-score against earlier rows only: the form of group_zscore that leaks nothing."""
    over = by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(over), F.stddev_samp(value).over(over)), F.lit(0.0))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(by(keys, order))).where("_place = 1").drop("_place")
