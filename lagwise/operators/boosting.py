"""Boosted trees of log loss by histograms, with L1, L2 and column sampling.

Values are cut into quantile bins once and written. A level of a tree takes one job: tasks
add up gradient and Hessian by (node, feature, bin), and the driver picks each node's best
split from the sums, which are 2^level x features x bins numbers however many rows there
are. With G and H the sums of a node, its leaf is -soft(G, l1) / (H + l2), and a split gains
half of soft(G, l1)^2 / (H + l2) of both sides less that of the node."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage, unstage
from .sums import matrix, summed

#: After so many trees the rows' scores are written anew, so that a job walks few trees.
REFRESH = 16


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: the children of i are 2i + 1, where a value is at most the cut,
    and 2i + 2. feature is -1 at leaves; missing_left says where missing values go."""

    feature: list[int]
    cut: list[float]
    bin: list[int]
    missing_left: list[bool]
    value: list[float]
    gain: list[float]

    @classmethod
    def stump(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0.0] * n, [0] * n, [False] * n, [0.0] * n, [0.0] * n)

    def walk(self, x: np.ndarray, missing: np.ndarray, cut: Sequence[float]) -> np.ndarray:
        """The node where each row ends, by values or by bins, whichever the cuts are of."""
        feature, cut, missing_left = np.array(self.feature), np.array(cut), np.array(self.missing_left)
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(len(feature).bit_length() - 1):
            f = feature[node]
            g = np.maximum(f, 0)
            left = np.where(missing[rows, g], missing_left[node], x[rows, g] <= cut[node])
            node = np.where(f >= 0, 2 * node + 2 - left, node)
        return node


@dataclass(frozen=True)
class Settings:
    """trees of depth, each weighed by rate; l1 and l2 penalise leaves, least_gain and
    least_weight (a side's Hessian) bar splits; rows and columns are the shares that each
    tree sees, dealt by a hash of the row and by seed."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 64
    seed: int = 42


def _soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _worth(g, h, s: Settings):
    return np.divide(_soft(g, s.l1) ** 2, h + s.l2, out=np.zeros(np.broadcast(g, h).shape), where=np.asarray(h + s.l2) > 0)


def _leaf(g: float, h: float, s: Settings) -> float:
    return float(-s.rate * _soft(g, s.l1) / (h + s.l2)) if h + s.l2 > 0 else 0.0


def best_split(sums: np.ndarray, features: Sequence[int], s: Settings) -> tuple[float, int, int, bool, tuple] | None:
    """Of one node's sums, features x bins x (G, H), bin 0 being missing values: gain,
    feature, last bin of the left side, whether missing goes left, and both sides' sums.
    Ties go to the first feature, the lowest bin, and missing to the right."""
    whole = sums[0].sum(axis=0)
    present = sums[:, 1:].cumsum(axis=1)[:, :-1]
    if not present.size:
        return None
    left = np.stack([present, present + sums[:, :1]])
    right = whole - left
    gain = (_worth(left[..., 0], left[..., 1], s) + _worth(right[..., 0], right[..., 1], s) - _worth(whole[0], whole[1], s)) / 2 - s.least_gain
    allowed = (left[..., 1] >= max(s.least_weight, 1e-12)) & (right[..., 1] >= max(s.least_weight, 1e-12))
    gain = np.where(allowed, gain, -np.inf).transpose(1, 2, 0)
    # sums of another order differ in their last digits: what is as good as the best is a tie
    best = gain.max()
    if not best > 1e-9:
        return None
    f, b, side = np.unravel_index(np.argmax(gain >= best - 1e-10 * max(1.0, best)), gain.shape)
    return float(gain[f, b, side]), features[f], int(b) + 1, bool(side), (left[side, f, b], right[side, f, b])


def _kept(key: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Which rows a tree sees: a hash of key and tree under the share of rows."""
    if s.rows >= 1:
        return np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((s.seed * 1_000_003 + tree + 1) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z ^= z >> np.uint64(31)
    return z / 2.0**64 < s.rows


class BoostedModel(Model, MLWritable, MLReadable):
    """df plus probability, a vector of the chances of 0 and 1. A NaN counts as missing."""

    def __init__(self, start: float = 0.0, trees: Sequence[Tree] = (), inputs: int = 0, features: str = "features"):
        super().__init__()
        self.start, self.trees, self.inputs, self.features = start, list(trees), inputs, features

    def margins(self, x: np.ndarray) -> np.ndarray:
        missing, out = np.isnan(x), np.full(len(x), self.start)
        for t in self.trees:
            out += np.array(t.value)[t.walk(x, missing, t.cut)]
        return out

    @property
    def importances(self) -> np.ndarray:
        """The mean gain of each feature's splits, as shares of their sum."""
        total, n = np.zeros(self.inputs), np.zeros(self.inputs)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += g
                    n[f] += 1
        mean = total / np.maximum(n, 1)
        return mean / mean.sum() if mean.sum() > 0 else mean

    def _transform(self, df: DataFrame) -> DataFrame:
        margins = self.margins

        @F.pandas_udf("double")
        def chance(rows: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-np.clip(margins(np.stack(rows.to_numpy())), -700, 700))) if len(rows) else [], dtype=float)

        p = chance(vector_to_array(self.features))
        return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: BoostedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        said = {"start": m.start, "inputs": m.inputs, "features": m.features, "trees": [asdict(t) for t in m.trees]}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"fitted": said})


class _Reader(MLReader):
    def load(self, path: str) -> BoostedModel:
        said = DefaultParamsReader.loadMetadata(path, self.sparkSession)["fitted"]
        return BoostedModel(said["start"], [Tree(**t) for t in said["trees"]], said["inputs"], said["features"])


class Boosted(Estimator):
    """Fits BoostedModel on features (a vector) and label (0 or 1).

    Rows of one label give a chance near it, an empty table one of a half, both without
    trees. Equal rows are seen by the same trees."""

    def __init__(self, settings: Settings | None = None, features: str = "features", label: str = "label", **changes):
        super().__init__()
        self.settings, self.features, self.label = replace(settings or Settings(), **changes), features, label

    def _edges(self, df: DataFrame, k: int) -> list[list[float]]:
        """Each feature's cuts: different quantiles of its values, without the greatest."""
        shares = [i / self.settings.bins for i in range(1, self.settings.bins + 1)]
        x = [F.get("x", F.lit(i)) for i in range(k)]
        row = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), c), shares, 100_000).alias(f"q{i}") for i, c in enumerate(x)]).first()
        return [sorted(set(row[f"q{i}"] or []))[:-1] for i in range(k)]

    def _binned(self, df: DataFrame, edges: list[list[float]]) -> DataFrame:
        """key, label, score and bins of every row; bin 0 is a missing value."""

        def binned(batches):
            for b in batches:
                if b.num_rows:
                    x = matrix(b, "x")
                    bins = np.column_stack([np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(e, x[:, i])) for i, e in enumerate(edges)]).astype(np.int16)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bins.size + 1, len(edges), dtype=np.int32)), pa.array(bins.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), b.column("score"), flat], ["key", "label", "score", "bins"])

        return stage(df.select("key", "label", "score", "x").mapInArrow(binned, "key long, label double, score double, bins array<short>"))

    def _fit(self, df: DataFrame) -> BoostedModel:
        s = self.settings
        rows = df.select(F.col(self.label).cast("double").alias("label"), vector_to_array(self.features).alias("x")).withColumn("key", F.xxhash64("x", "label"))
        n, ones, k = rows.agg(F.count(F.lit(1)), F.sum("label"), F.max(F.size("x"))).first()
        start = float(np.log((ones + 1e-6) / (n - ones + 1e-6))) if n else 0.0
        if not n or ones in (0, n):
            return BoostedModel(start, [], k or 0, self.features)
        edges = self._edges(rows, k)
        data = self._binned(rows.withColumn("score", F.lit(start)), edges)
        rng, trees, fresh = np.random.default_rng(s.seed), [], []
        try:
            for i in range(s.trees):
                chosen = sorted(rng.choice(k, max(1, round(k * s.columns)), replace=False).tolist())
                tree = self._grow(data, fresh, i, chosen, edges)
                trees.append(tree)
                fresh.append(tree)
                if len(fresh) == REFRESH and i + 1 < s.trees:
                    newer = stage(data.mapInArrow(_advance(fresh), data.schema))
                    unstage(data)
                    data, fresh = newer, []
        finally:
            unstage(data)
        return BoostedModel(start, trees, k, self.features)

    def _grow(self, data: DataFrame, fresh: list[Tree], number: int, chosen: list[int], edges: list[list[float]]) -> Tree:
        s, tree = self.settings, Tree.stump(self.settings.depth)
        width = 3 + max(len(e) for e in edges)  # one past the bins, so that missing against present is a split too
        open_nodes = [0]
        for _ in range(s.depth):
            sums = summed(data, len(open_nodes) * len(chosen) * width * 2, _histogram(tree, open_nodes, fresh, number, chosen, width, s))
            sums = sums.reshape(len(open_nodes), len(chosen), width, 2)
            below = []
            for node, own in zip(open_nodes, sums, strict=True):
                if node == 0:
                    tree.value[0] = _leaf(*own[0].sum(axis=0), s)
                found = best_split(own, chosen, s)
                if found:
                    gain, f, b, missing_left, sides = found
                    tree.feature[node], tree.bin[node], tree.cut[node] = f, b, edges[f][b - 1] if b <= len(edges[f]) else float("inf")
                    tree.missing_left[node], tree.gain[node] = missing_left, gain
                    for child, (g, h) in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
                        tree.value[child] = _leaf(g, h, s)
                        below.append(child)
            if not below:
                break
            open_nodes = below
        return tree


def _scores(batch: pa.RecordBatch, bins: np.ndarray, fresh: list[Tree]) -> np.ndarray:
    score, missing = batch.column("score").to_numpy(), bins == 0
    for t in fresh:
        score = score + np.array(t.value)[t.walk(bins, missing, t.bin)]
    return score


def _advance(fresh: list[Tree]):
    def advance(batches):
        for b in batches:
            if b.num_rows:
                yield b.set_column(b.schema.get_field_index("score"), "score", pa.array(_scores(b, matrix(b, "bins"), fresh)))

    return advance


def _histogram(tree: Tree, open_nodes: list[int], fresh: list[Tree], number: int, chosen: list[int], width: int, s: Settings):
    """What a batch adds to the sums of (open node, chosen feature, bin, G or H)."""
    place = np.full(len(tree.feature), -1)
    place[open_nodes] = np.arange(len(open_nodes))

    def of(batch: pa.RecordBatch) -> np.ndarray:
        bins = matrix(batch, "bins")
        p = 1 / (1 + np.exp(-np.clip(_scores(batch, bins, fresh), -700, 700)))
        g, h = p - batch.column("label").to_numpy(), p * (1 - p)
        at = place[tree.walk(bins, bins == 0, tree.bin)]
        seen = (at >= 0) & _kept(batch.column("key").to_numpy(), number, s)
        at, g, h, bins = at[seen], g[seen], h[seen], bins[seen]
        out = np.zeros((len(open_nodes), len(chosen), width, 2))
        for j, f in enumerate(chosen):
            cell = at * width + bins[:, f]
            for c, w in enumerate((g, h)):
                out[:, j, :, c] = np.bincount(cell, w, len(open_nodes) * width).reshape(len(open_nodes), width)
        return out.ravel()

    return of
