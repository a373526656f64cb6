"""Chronological splits and expanding-window folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chrono_split(season, train_end, val_end):
    """Column: train up to train_end, val up to val_end, test after; null is test."""
    s = F.col(season) if isinstance(season, str) else season
    return F.when(s <= train_end, "train").when(s <= val_end, "val").otherwise("test")


def positions(df: DataFrame, first: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """df plus its place from 0 in the order of first (a date or number) and order.

    Rows are numbered within each value of `first`; only the counts of these values
    are summed in one place, so that no task sees all rows."""
    counts = df.groupBy(first).agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(first, F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_base"))
    own = df.withColumn("_own", F.row_number().over(Window.partitionBy(first).orderBy(*order)) - 1)
    return own.join(base, first).withColumn(name, F.col("_base") + F.col("_own")).drop("_base", "_own")


def fold_bounds(n: int, folds: int) -> list[tuple[int, int]]:
    """[first, last) positions that each fold validates; it trains on all before first."""
    t = n // (folds + 1)
    if t < 1:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    return [(n - (folds - i) * t, n - (folds - i - 1) * t) for i in range(folds)]


def fold_of(position: str, bounds: list[tuple[int, int]]):
    """Column: the fold that validates the row, -1 for rows that only train."""
    out = F.lit(-1)
    for i, (a, b) in enumerate(bounds):
        out = F.when((F.col(position) >= a) & (F.col(position) < b), i).otherwise(out)
    return out
