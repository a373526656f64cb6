"""Models on MLlib: scaling, PCA, classifiers, expanding-window search, calibration,
importance. Data frames hold a features vector and a label; the driver holds
parameters, folds and fitted models."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.staging import stage, unstage

from .metrics import binary_metrics
from .splits import fold_bounds, positions
from .sums import matrix


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """df plus a vector of the columns, nulls as 0."""
    return df.withColumn(output, array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])))


def scale_by_train(df: DataFrame, columns: Sequence[str], split: str = "split", train: Sequence[str] = ("train",)) -> DataFrame:
    """df with each column less the mean and over the population sd of its train rows; a
    constant column becomes 0. One aggregation of one row, joined to all."""
    return scaled_by(df, df.where(F.col(split).isin(*train)), columns)


def scaled_by(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """scale_by_train by the rows of another table with these columns."""
    stats = train.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    row = stats.first()
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.lit(row[f"_m_{c}"]), F.lit(row[f"_s_{c}"])), F.lit(0.0)) for c in columns})


def pca_by_train(df: DataFrame, vector: str, k: int, train) -> tuple[DataFrame, list[float]]:
    """df plus pca_1..pca_k of the vector, standardised and fitted on the rows of train
    (a Column), and the explained variance. Of each axis the largest loading is made
    positive, as its sign is arbitrary."""
    return pca_by(df, df.where(train), vector, k)


def pca_by(df: DataFrame, train: DataFrame, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """pca_by_train by the rows of another table with the vector. One pass over it: moments
    of tasks about their own means are put together, so nothing is lost to large means."""
    n, mean, scatter = _moments(train.select(vector_to_array(vector).alias("x")))
    if n < 2:
        raise ValueError(f"{n} rows are too few for components")
    sd = np.sqrt(np.diag(scatter) / (n - 1))
    unit = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
    found, axes = np.linalg.eigh(scatter / (n - 1) * np.outer(unit, unit))
    axes, found = axes[:, ::-1][:, :k], np.clip(found[::-1], 0, None)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    loads = unit[:, None] * axes
    a = vector_to_array(vector)
    scores = [F.aggregate(F.zip_with("_a", F.array(*[F.lit(float(w)) for w in loads[:, i]]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) - float(mean @ loads[:, i]) for i in range(k)]
    out = df.withColumn("_a", a).withColumns({f"pca_{i + 1}": s for i, s in enumerate(scores)}).drop("_a")
    return out, [float(x) for x in found[:k] / found.sum()]


def _moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and sums of products about the mean of x, an array of one length. Each
    task gives one row; the driver puts these together."""

    def joined(a, b):
        n = a[0] + b[0]
        step = b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = matrix(b, "x")
                m = x.mean(axis=0)
                part = len(x), m, (x - m).T @ (x - m)
                total = part if total is None else joined(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tolist()]), pa.array([total[2].ravel().tolist()])], ["n", "mean", "scatter"])

    total = None
    for r in df.mapInArrow(own, "n long, mean array<double>, scatter array<double>").toLocalIterator():
        part = r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1)
        total = part if total is None else joined(total, part)
    return total or (0, np.zeros(0), np.zeros((0, 0)))


def logistic(c: float = 1.0, rows: int = 1) -> LogisticRegression:
    """Ridge logistic regression of half the squared weights plus c times summed loss."""
    return LogisticRegression(elasticNetParam=0.0, regParam=1 / (c * max(rows, 1)), standardization=False, maxIter=100)


def trees(**params) -> GBTClassifier:
    return GBTClassifier(seed=42, **params)


def perceptron(inputs: int, hidden: Sequence[int] = (8,), **params) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], seed=42, **params)


def chance(df: DataFrame, model: Model, name: str = "p") -> DataFrame:
    """df plus the model's chance of label 1."""
    return model.transform(df).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")


def log_loss(df: DataFrame, score: str = "p") -> float:
    return binary_metrics(df, "label", score).first()["log_loss"]


@dataclass(frozen=True)
class Result:
    params: dict
    losses: list[float]

    @property
    def loss(self) -> float:
        return sum(self.losses) / len(self.losses)


def expanding_cv(df: DataFrame, make: Callable[[dict, int], Estimator], candidates: Sequence[dict], folds: int = 5, parallel: int = 4) -> list[Result]:
    """Each candidate's log loss in each fold, best first. df has a position column; a
    fold trains on all rows before those that it validates, and make gets the number of
    these rows too. Fits run side by side."""
    df = df.cache()
    bounds = fold_bounds(df.count(), folds)

    def one(job):
        params, (a, b) = job
        model = make(params, a).fit(df.where(F.col("position") < a))
        return log_loss(chance(df.where((F.col("position") >= a) & (F.col("position") < b)), model))

    with ThreadPoolExecutor(parallel) as pool:
        losses = list(pool.map(one, [(p, b) for p in candidates for b in bounds]))
    df.unpersist()
    found = [Result(p, losses[i * folds : (i + 1) * folds]) for i, p in enumerate(candidates)]
    return sorted(found, key=lambda r: r.loss)


def grid(space: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(space, values, strict=True)) for values in product(*space.values())]


def draws(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n different points of the grid, or all if it has fewer."""
    every = grid(space)
    return every if len(every) <= n else random.Random(seed).sample(every, n)


@dataclass(frozen=True)
class Calibrated:
    """The mean of the folds' models, each with a sigmoid of its score."""

    parts: list[tuple[Model, float, float]]

    def transform(self, df: DataFrame, name: str = "p") -> DataFrame:
        out, total = df, F.lit(0.0)
        for i, (model, slope, shift) in enumerate(self.parts):
            out = chance(out, model, f"_p{i}")
            total = total + 1 / (1 + F.exp(-(_logit(f"_p{i}") * slope + shift)))
        return out.withColumn(name, total / len(self.parts)).drop(*[f"_p{i}" for i in range(len(self.parts))])


def _logit(p: str):
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.ln(q / (1 - q))


def calibrate(df: DataFrame, make: Callable[[int], Estimator], folds: int = 5, parallel: int = 4) -> Calibrated:
    """Per fold: fit what make gives for so many rows on what is before it, then a sigmoid on the fold's own scores, with
    targets drawn in from 0 and 1 by the number of examples of each label. Folds are fitted side by side, so that the
    many short jobs of one fit don't leave the cluster idle between them."""

    def one(bounds: tuple[int, int]) -> tuple[Model, float, float]:
        a, b = bounds
        model = make(a).fit(df.where(F.col("position") < a))
        seen = chance(df.where((F.col("position") >= a) & (F.col("position") < b)), model).select("label", array_to_vector(F.array(_logit("p"))).alias("features"))
        n = seen.agg(F.sum("label"), F.count(F.lit(1))).first()
        pos, neg = float(n[0]), float(n[1] - n[0])
        hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
        target = F.when(F.col("label") == 1, hi).otherwise(lo)
        both = seen.withColumn("t", target).select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("t").alias("w")),
                                                                               F.struct(F.lit(0.0).alias("label"), (1 - F.col("t")).alias("w")))).alias("x")).select("features", "x.*")
        fit = LogisticRegression(regParam=0.0, weightCol="w").fit(both)
        return model, float(fit.coefficients[0]), float(fit.intercept)

    with ThreadPoolExecutor(parallel) as pool:
        return Calibrated(list(pool.map(one, fold_bounds(df.count(), folds))))


def coefficient_ranking(spark, model, columns: Sequence[str]) -> DataFrame:
    rows = [(c, float(w), abs(float(w))) for c, w in zip(columns, model.coefficients.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, importance double").orderBy(F.col("importance").desc(), "feature")


def tree_importance(spark, model, columns: Sequence[str]) -> DataFrame:
    rows = [(c, float(w)) for c, w in zip(columns, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def retrain_calibrated(df: DataFrame, columns: Sequence[str], make: Callable[[int], Estimator], first: str, order: Sequence[str], folds: int = 5,
                       split: str = "split", parts: Sequence[str] = ("train", "val")) -> DataFrame:
    """df plus p: scaler, folds and their sigmoids are all fitted anew on the parts, and
    every row is scored. df has label, first (a date or number) and order, which give the
    positions of the folds."""
    scaled = assemble(scale_by_train(df, columns, split, parts), columns)
    # a cached table would keep the shuffle's many small parts, each a task of every pass of every fit
    own = stage(positions(scaled.where(F.col(split).isin(*parts)), first, order).select("features", "label", "position"))
    model = calibrate(own, make, folds)
    unstage(own)
    return model.transform(scaled).drop("features")


def retrain(df: DataFrame, make: Callable[[], Estimator], columns: Sequence[str], split: str = "split", parts: Sequence[str] = ("train", "val")) -> PipelineModel:
    """A pipeline of assembling, standardising and the estimator, fitted on the parts."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="skip"),
                            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True), make()]).fit(df.where(F.col(split).isin(*parts)))
