"""Repeated loads: of a history kept in a folder a season, only what changed is replaced,
and features are made again from the first changed season on.

What a later season needs of the earlier ones is carried: after each season, the last rows
of every key are written beside the features. So a load reads the changed and later seasons
and one season's carry, never the whole history. Each folder is overwritten whole, so a load
that was broken off is mended by running it again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replace_seasons(df: DataFrame, path: str, season: str) -> list:
    """Write df's rows in place of its seasons' folders; others stay. Returns the seasons,
    which are numbers or texts without nulls; an empty df replaces nothing."""
    found = sorted(r[0] for r in df.select(season).distinct().collect())
    if any(s is None for s in found):
        raise ValueError(f"{season} is null in some rows")
    if found:
        df.write.partitionBy(season).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return found


def seasons_at(spark: SparkSession, path: str, season: str) -> list:
    """The seasons that have a folder; no column of the files is read."""
    return sorted(r[0] for r in spark.read.parquet(path).select(season).distinct().collect())


def refresh(spark: SparkSession, raw: str, out: str, features: Callable[[DataFrame], DataFrame], season: str, keys: Sequence[str], order: Sequence[str],
            lookback: int, since=None) -> list:
    """Make the features of the seasons from since on (None: of all) and return these
    seasons. They are in out/features and the rows carried in out/carry, a folder a season.

    features adds columns that look at no more than lookback earlier rows of a row's keys;
    order must not put a row before one of an earlier season. One season at a time, each a
    job over its own rows and the carry."""
    known = seasons_at(spark, raw, season)
    due = [s for s in known if since is None or s >= since]
    table = spark.read.parquet(raw)
    for s in due:
        rows, ahead = table.where(F.col(season) == s), [x for x in known if x < s]
        if ahead:
            rows = rows.unionByName(_carry(spark, out, ahead[-1], table))
        made = features(rows).where(F.col(season) == s)
        made.drop(season).write.mode("overwrite").parquet(f"{out}/features/{season}={s}")
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
        last = rows.withColumn("_place", place).where(F.col("_place") <= lookback).drop("_place")
        last.write.mode("overwrite").parquet(f"{out}/carry/{s}")
    return due


def _carry(spark: SparkSession, out: str, s, table: DataFrame) -> DataFrame:
    return spark.read.schema(table.schema).parquet(f"{out}/carry/{s}")
