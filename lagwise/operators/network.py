"""A network for the chance of a label, trained by gradients summed in Spark.

Each step takes one job: tasks add up loss and gradient over their rows at the given
weights, of the training rows, and the loss alone of the last part in time, which is held
back. Steps are quasi-Newton ones whose length adapts: halved until the training loss falls
enough, and full again after that. Training stops when the loss held back no longer falls,
and the weights where it was least are kept."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import matrix, summed

_CURVES = {"tanh": (np.tanh, lambda a: 1 - a * a), "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float))}
_MEMORY = 10


def layers_of(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The matrix and the shifts of each layer, out of one array of all."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _decayed(sizes: Sequence[int]) -> np.ndarray:
    """1 for weights, 0 for shifts, which have no penalty."""
    return np.concatenate([np.repeat([1.0, 0.0], [a * b, b]) for a, b in zip(sizes, sizes[1:], strict=False)])


def forward(x: np.ndarray, weights: np.ndarray, sizes: Sequence[int], activation: str) -> list[np.ndarray]:
    """Each layer's output, the rows first and the last one's log odds at last."""
    curve, out = _CURVES[activation][0], [x]
    layers = layers_of(weights, sizes)
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if i == len(layers) - 1 else curve(z))
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, sizes: Sequence[int], activation: str) -> tuple[float, np.ndarray]:
    """Summed log loss of the rows and its gradient, without penalty."""
    out = forward(x, weights, sizes, activation)
    z = out[-1][:, 0]
    error = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y)[:, None]
    parts = []
    for (w, _), a in zip(reversed(layers_of(weights, sizes)), reversed(out[:-1]), strict=True):
        parts += [error.sum(axis=0), (a.T @ error).ravel()]
        error = (error @ w.T) * _CURVES[activation][1](a)
    return float((np.logaddexp(0, z) - y * z).sum()), np.concatenate(parts[::-1])


@dataclass
class Point:
    """Mean penalised loss and gradient of the training rows, mean loss of those held back."""

    weights: np.ndarray
    loss: float
    gradient: np.ndarray
    held: float


def train(at: Callable[[np.ndarray], Point], first: np.ndarray, most: int, patience: int, tolerance: float) -> tuple[np.ndarray, int, str]:
    """Weights of least held-back loss, the steps taken, and why they ended: 'held back' if
    it did not fall by tolerance in so many steps, 'settled' at a flat point, or 'bound'."""
    p = at(first)
    best, waited, moves = p, 0, []
    for step in range(1, most + 1):
        if np.abs(p.gradient).max() < 1e-6:
            return best.weights, step - 1, "settled"
        d, later = p.gradient.copy(), []
        for s, y in reversed(moves):
            later.append((s @ d) / (s @ y))
            d -= later[-1] * y
        if moves:
            s, y = moves[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, np.linalg.norm(d))
        for (s, y), a in zip(moves, reversed(later), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        length, slope = 1.0, p.gradient @ d
        while True:
            q = at(p.weights - length * d)
            if q.loss <= p.loss - 1e-4 * length * slope:
                break
            length /= 2
            if length < 1e-6:
                return best.weights, step, "settled"
        s, y = q.weights - p.weights, q.gradient - p.gradient
        if s @ y > 1e-10 * (y @ y):
            moves = [*moves[1 - _MEMORY :], (s, y)]
        p = q
        if p.held < best.held - tolerance:
            best, waited = p, 0
        else:
            waited += 1
            if waited >= patience:
                return best.weights, step, "held back"
    return best.weights, most, "bound"


class NetworkModel(Model, MLWritable, MLReadable):
    """df plus probability, a vector of the chances of 0 and 1."""

    def __init__(self, sizes: Sequence[int] = (0, 1), activation: str = "relu", weights: Sequence[float] = (), steps: int = 0, ended: str = "", features: str = "features"):
        super().__init__()
        self.sizes, self.activation, self.weights = list(sizes), activation, np.asarray(weights, float)
        self.steps, self.ended, self.features = steps, ended, features

    def _transform(self, df: DataFrame) -> DataFrame:
        weights, sizes, activation = self.weights, self.sizes, self.activation

        @F.pandas_udf("double")
        def chance(rows: pd.Series) -> pd.Series:
            z = forward(np.stack(rows.to_numpy()), weights, sizes, activation)[-1][:, 0] if len(rows) and sizes[0] else np.zeros(len(rows))
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

        out = df.withColumn("_p", chance(vector_to_array(self.features)))
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: NetworkModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        said = {"sizes": m.sizes, "activation": m.activation, "weights": m.weights.tolist(), "steps": m.steps, "ended": m.ended, "features": m.features}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"fitted": said})


class _Reader(MLReader):
    def load(self, path: str) -> NetworkModel:
        return NetworkModel(**DefaultParamsReader.loadMetadata(path, self.sparkSession)["fitted"])


class Network(Estimator):
    """Fits NetworkModel on features (a vector of finite numbers), label (0 or 1) and position.

    hidden are the sizes of the layers between, activation is tanh or relu, l2 weighs half
    the squared weights over the number of training rows. The last share of the rows by
    position is held back; with fewer than ten rows none is, and the training loss stands in
    for theirs. An empty table gives a chance of a half."""

    def __init__(self, hidden: Sequence[int] = (8,), activation: str = "relu", l2: float = 1e-4, most: int = 200, held_back: float = 0.1, patience: int = 10,
                 tolerance: float = 1e-5, seed: int = 42, features: str = "features", label: str = "label", position: str = "position"):
        super().__init__()
        if activation not in _CURVES:
            raise ValueError(f"activation {activation!r} is none of {sorted(_CURVES)}")
        self.hidden, self.activation, self.l2, self.most, self.held_back = tuple(hidden), activation, l2, most, held_back
        self.patience, self.tolerance, self.seed = patience, tolerance, seed
        self.features, self.label, self.position = features, label, position

    def first_weights(self, sizes: Sequence[int]) -> np.ndarray:
        """Uniform draws as wide as a layer's inputs and outputs ask for; no shifts."""
        rng = np.random.default_rng(self.seed)
        return np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(sizes, sizes[1:], strict=False)])

    def point(self, rows: DataFrame, sizes: Sequence[int], bound: float, weights: np.ndarray) -> Point:
        """One job: rows has x, y and at; those at bound and after are held back."""
        activation = self.activation

        def of(batch: pa.RecordBatch) -> np.ndarray:
            x, y, held = matrix(batch, "x"), batch.column("y").to_numpy(), batch.column("at").to_numpy() >= bound
            loss, gradient = loss_and_gradient(x[~held], y[~held], weights, sizes, activation)
            z = forward(x[held], weights, sizes, activation)[-1][:, 0]
            return np.concatenate([[(~held).sum(), loss, held.sum(), (np.logaddexp(0, z) - y[held] * z).sum()], gradient])

        n, loss, n_held, held, *gradient = summed(rows, 4 + len(weights), of)
        decayed, n = _decayed(sizes) * weights, max(n, 1)
        loss = (loss + self.l2 * (decayed @ decayed) / 2) / n
        return Point(weights, loss, (np.array(gradient) + self.l2 * decayed) / n, held / n_held if n_held else loss)

    def _fit(self, df: DataFrame) -> NetworkModel:
        rows = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), F.col(self.position).cast("double").alias("at")).persist()
        try:
            n, low, high, k = rows.agg(F.count(F.lit(1)), F.min("at"), F.max("at"), F.max(F.size("x"))).first()
            sizes = [k or 0, *self.hidden, 1]
            first = self.first_weights(sizes)
            if not n:
                return NetworkModel(sizes, self.activation, np.zeros(len(first)), 0, "empty", self.features)
            bound = low + (high - low + 1) * (1 - self.held_back) if n >= 10 else float("inf")
            weights, steps, ended = train(lambda w: self.point(rows, sizes, bound, w), first, self.most, self.patience, self.tolerance)
            return NetworkModel(sizes, self.activation, weights, steps, ended, self.features)
        finally:
            rows.unpersist()
