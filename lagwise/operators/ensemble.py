"""A fitted blend as one stage: scaler, calibrated fold models, weights and feature list,
saved and loaded whole."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.staging import stage, unstage

from . import blend
from .models import Calibrated, assemble, calibrate
from .splits import positions


@dataclass(frozen=True)
class Member:
    """A calibrated model and its weight in the blend."""

    name: str
    model: Calibrated
    weight: float


class BlendModel(Model, MLWritable, MLReadable):
    """df plus p_<member> for each member and p, their weighted mean.

    columns are standardised by means and deviations of the rows that the models were
    fitted on; a null, or a column without deviation, becomes 0. Rows are scored alone: an
    empty table gives an empty one."""

    def __init__(self, columns: Sequence[str] = (), means: Sequence[float] = (), deviations: Sequence[float] = (), members: Sequence[Member] = (), info: dict | None = None):
        super().__init__()
        self.columns, self.means, self.deviations = list(columns), list(means), list(deviations)
        self.members, self.info = list(members), dict(info or {})

    def scaled(self, df: DataFrame) -> DataFrame:
        """df plus features."""
        own = [F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)) if s else F.lit(0.0) for c, m, s in zip(self.columns, self.means, self.deviations, strict=True)]
        names = [f"_f{i}" for i in range(len(own))]
        return assemble(df.withColumns(dict(zip(names, own, strict=True))), names, "features").drop(*names)

    def _transform(self, df: DataFrame) -> DataFrame:
        out, total = self.scaled(df), F.lit(0.0)
        for m in self.members:
            out = m.model.transform(out, f"p_{m.name}")
            total = total + F.col(f"p_{m.name}") * m.weight
        return out.withColumn("p", total).drop("features")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """metadata/: one line of JSON. members/<member>/<fold>: each fold's model by its own writer."""

    def __init__(self, model: BlendModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        said = {"columns": m.columns, "means": m.means, "deviations": m.deviations, "info": m.info,
                "members": [{"name": x.name, "weight": x.weight, "sigmoids": [[slope, shift] for _, slope, shift in x.model.parts]} for x in m.members]}
        self.sparkSession.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        for i, x in enumerate(m.members):
            for k, (part, _, _) in enumerate(x.model.parts):
                part.write().save(f"{path}/members/{i}/{k}")


class _Reader(MLReader):
    def load(self, path: str) -> BlendModel:
        spark = SparkSession.active()
        said = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        members = []
        for i, x in enumerate(said["members"]):
            parts = [(DefaultParamsReader.loadParamsInstance(f"{path}/members/{i}/{k}", spark), slope, shift) for k, (slope, shift) in enumerate(x["sigmoids"])]
            members.append(Member(x["name"], Calibrated(parts), x["weight"]))
        return BlendModel(said["columns"], said["means"], said["deviations"], members, said["info"])


def fit_blend(df: DataFrame, columns: Sequence[str], makers: dict[str, Callable[[int], Estimator]], first: str, order: Sequence[str], folds: int = 5,
              split: str = "split", train: str = "train", val: str = "val") -> BlendModel:
    """A BlendModel of one calibrated model for each maker, blended by the weights of least
    log loss on val, then with scaler, models and sigmoids fitted anew on train and val.

    df has label, split, the columns, and first (a date or number) and order, which put the
    rows in one order for the expanding folds."""

    def fitted(rows: DataFrame, weights: Sequence[float], info: dict) -> BlendModel:
        stats = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        means, deviations = ([float(stats[f"{n}{i}"] or 0.0) for i in range(len(columns))] for n in "ms")
        # staged, as a cached table would keep the shuffle's many small parts in every pass of every fit
        own = stage(positions(BlendModel(columns, means, deviations).scaled(rows), first, order).select("features", "label", "position"))
        members = [Member(name, calibrate(own, make, folds), float(w)) for (name, make), w in zip(makers.items(), weights, strict=True)]
        unstage(own)
        return BlendModel(columns, means, deviations, members, info)

    first_fit = fitted(df.where(F.col(split) == train), [1 / len(makers)] * len(makers), {})
    scored = first_fit.transform(df.where(F.col(split) == val))
    found = blend.simplex_weights(scored, "label", [f"p_{name}" for name in makers])
    return fitted(df.where(F.col(split).isin(train, val)), found.weights, {"log_loss_on_val": found.loss, "gap": found.gap})
