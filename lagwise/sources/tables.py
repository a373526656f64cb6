"""Sources: declared schemas, seasons in one scan, errors that name the stage."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingStage(RuntimeError):
    """The input of a stage isn't there; the stage that writes it has to run first."""


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, form: str = "parquet", stage: str = "") -> DataFrame:
    """A table as Parquet, CSV with a header, JSON or ORC. CSV and JSON need a schema:
    inferred ids lose their leading zeros."""
    if form in ("csv", "json") and schema is None:
        raise ValueError(f"{form} needs a schema")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingStage(f"{path} is missing: run {stage or 'the stage that writes it'} first") from e
        raise


def read_seasons(spark: SparkSession, path: str, schema: T.StructType | str | None = None, form: str = "parquet") -> DataFrame:
    """All season=... folders below path in one scan, with a season column; filters on
    it read only their folders."""
    return read_table(spark, path, schema, form).withColumn("season", F.col("season").cast("string"))


def union_seasons(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of all parts; columns that a part lacks are null."""
    if not parts:
        raise ValueError("no parts")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def season_list(spark: SparkSession, today: str, first: int = 2000) -> DataFrame:
    """season ('2000-01' ...) and start_year, up to the season that runs on that date
    (yyyy-mm-dd); a new one starts in October."""
    m = re.fullmatch(r"(\d{4})-(\d{2})-\d{2}", today)
    if not m:
        raise ValueError(today)
    last = int(m[1]) - (int(m[2]) < 10)
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("start_year"))
    return years.select(F.format_string("%d-%02d", "start_year", ((F.col("start_year") + 1) % 100)).alias("season"), "start_year")


def load_games(df: DataFrame, date: str = "game_date", season: str = "season_id", ids: Sequence[str] = ()) -> DataFrame:
    """df with the date as a date, ids as text, and season_year. Rows aren't sorted:
    windows state their own order."""
    out = df.withColumn(date, F.to_date(date)).withColumns({c: F.col(c).cast("string") for c in (season, *ids)})
    return out.withColumn("season_year", F.substring(season, 2, 4).try_cast("int"))
