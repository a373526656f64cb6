"""Sinks: datasets, metric tables, run records and models below one run's folder."""

from __future__ import annotations

import json
from datetime import date, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_path(base: str, started: datetime, name: str = "run") -> str:
    return f"{base.rstrip('/')}/{name}_{started:%Y%m%d_%H%M%S}"


def write_dataset(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    out = df.write.mode(mode)
    out = out.partitionBy(*by) if by else out
    if form == "csv":
        out.option("header", True).csv(path)
    else:
        out.format(form).save(path)


def plain(value):
    """value with NumPy scalars and arrays, dates and sets as JSON has them."""
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return [plain(x) for x in value.tolist()]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, (set, frozenset)):
        return sorted(map(plain, value))
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON object as a text file of one line."""
    spark.createDataFrame([(json.dumps(plain(record), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def metrics_table(spark: SparkSession, metrics: dict[str, dict[str, float]]) -> DataFrame:
    """One row per model, one column per metric, of a dict of dicts."""
    names = sorted({m for row in metrics.values() for m in row})
    rows = [(model, *[None if row.get(n) is None else float(row[n]) for n in names]) for model, row in metrics.items()]
    return spark.createDataFrame(rows, ", ".join(["model string", *[f"{n} double" for n in names]]))


def scaler_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean and population sd of each column, from one pass over df."""
    sums = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{i}").alias("mean"), F.col(f"s_{i}").alias("sd")) for i, c in enumerate(columns)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, kind=None):
    """A model that save_model has written; kind is its class, a pipeline if None."""
    from pyspark.ml import PipelineModel

    return (kind or PipelineModel).load(path)


def cv_results(spark: SparkSession, found) -> DataFrame:
    """rank, params, fold, log_loss of a search's results, the best first; params as JSON."""
    rows = [(i, json.dumps(plain(x.params), sort_keys=True), fold, float(loss)) for i, x in enumerate(found) for fold, loss in enumerate(x.losses)]
    return spark.createDataFrame(rows, "rank int, params string, fold int, log_loss double")


def write_search(spark: SparkSession, found, path: str) -> None:
    """A search's results as a table and its best parameters as a record, below path."""
    write_dataset(cv_results(spark, found), f"{path}/cv_results")
    write_record(spark, dict(found[0].params), f"{path}/best_params")


def report(metrics: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """A metrics table for reading: accuracy in percent with one decimal, the rest with
    three, unless digits has the column's own number."""
    digits = digits or {}
    cut = {c: F.round(F.col(c) * (100 if c == "accuracy" else 1), digits.get(c, 1 if c == "accuracy" else 3))
           for c, t in metrics.dtypes if t == "double"}
    return metrics.withColumns(cut)
