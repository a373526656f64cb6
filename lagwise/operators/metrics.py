"""Metrics and curves of predicted chances, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.scalars import clip

#: Scores are summed within so many ranges; only the ranges' sums are added up in a row.
RANGES = 1_024


def binary_metrics(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy, log_loss, brier and n of each group of keys; a score of 0.5 predicts 1."""
    y, p = F.col(label).cast("double"), F.col(score)
    q = clip(p)
    return df.groupBy(*keys).agg(
        F.avg(((p >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"),
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"), F.count(F.lit(1)).alias("n"))


def roc_curve(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, score, tp, fp: positives and negatives at or above each different score
    (0 to 1), and pos and neg here."""
    tally = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    tally = tally.withColumn("_range", F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(F.col("score") * RANGES))).cast("int"))
    sums = tally.groupBy(*keys, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_b{c}") for c in ("_p", "_n")])
    own = Window.partitionBy(*keys, "_range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = tally.withColumns({"_op": F.sum("pos").over(own), "_on": F.sum("neg").over(own)}).join(base, [*keys, "_range"])
    return out.select(*keys, "score", (F.col("_b_p") + F.col("_op")).alias("tp"), (F.col("_b_n") + F.col("_on")).alias("fp"), "pos", "neg")


def roc_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """auc of each group: the chance that a positive scores above a negative, ties half.
    Null without both labels."""
    curve = roc_curve(df, label, score, keys)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")).cast("double") + F.col("neg") * F.col("pos") * 0.5)
    return curve.groupBy(*keys).agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Mean score and share of positives in each of so many equal bins, closed above."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col(score) * bins) - 1)).cast("int")
    return df.groupBy(*keys, at.alias("bin")).agg(
        F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(label).alias("label"), (F.col(score) >= 0.5).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
