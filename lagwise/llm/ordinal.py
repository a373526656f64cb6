"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - threshold_k), with one weight vector for all grades
over hashed byte trigrams of the text and a mark of words that repeat the one before.
Weights and thresholds together maximise the likelihood of the grades, the difference of
two neighbouring sigmoids, by L-BFGS; each step's loss and gradient are summed in Spark.
Thresholds are a first one and the logarithms of the gaps after it, so they are in order."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage

#: Hash buckets of trigrams; the mark of repeated words comes after them.
BUCKETS = 2_048
SIZE = BUCKETS + 1
#: The fit uses at most so many rated rows, the first by a hash of their id.
FIT_ROWS = 4_000
#: Half of this times the squared weights is added to the mean loss.
RIDGE = 1e-4
#: The fit ends when the gradient's norm is SETTLED times the loss (or 1, if that is more);
#: STEPS without getting there are an error.
STEPS, MEMORY, SETTLED = 1_000, 20, 2e-6
#: Texts are kept whose chance of a grade of at least KEEP_GRADE is KEEP_CHANCE or more.
KEEP_GRADE, KEEP_CHANCE = 1, 0.5
_BYTES_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class OrdinalModel:
    weights: tuple[float, ...]
    #: One less than grades, ascending: thresholds[i] divides grades[i] and grades[i + 1].
    thresholds: tuple[float, ...]
    grades: tuple[int, ...]


def hashed(text: str | None) -> np.ndarray:
    """Square roots of the shares of the hashed byte trigrams (all 0 for texts of less
    than three bytes), and that of the words which equal the word before them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    n = len(data) - 2
    counts = np.zeros(BUCKETS)
    for first in range(0, max(n, 0), _BYTES_AT_ONCE):
        b = data[first : first + _BYTES_AT_ONCE + 2].astype(np.uint32)
        mixed = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        counts += np.bincount(mixed, minlength=BUCKETS)
    words = raw.split()
    again = sum(map(operator.eq, words, words[1:]))
    return np.sqrt(np.append(counts / max(n, 1), again / max(len(words), 1)))


def fit(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade",
        rows: int = FIT_ROWS) -> OrdinalModel:
    """A model of ratings (doc_id, grade) by the texts of docs.

    Rows without id, grade or document are left out; of several grades of an id the
    least holds. With fewer than two grades there is no threshold and the model is a
    constant. Only the sampled ids (at most rows) are broadcast, never texts."""

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([hashed(t) for t in s])

    rated = ratings.where(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).groupBy(doc_id).agg(F.min(grade).cast("int").alias("_grade"))
    sample = stage(rated.orderBy(F.xxhash64(doc_id), doc_id).limit(rows))
    texts = docs.select(doc_id, text).join(F.broadcast(sample), doc_id)  # at most rows ids
    data = stage(texts.select("_grade", features(text).alias("x")).repartition(4))
    grades = sorted(r[0] for r in data.select("_grade").distinct().collect())  # at most rows
    if len(grades) < 2:
        return OrdinalModel((0.0,) * SIZE, (), tuple(grades))
    place = {g: k for k, g in enumerate(grades)}
    counts = data.groupBy("_grade").agg(F.count(F.lit(1)).alias("n")).collect()
    share = np.bincount([place[r._grade] for r in counts], [r.n for r in counts]) / sum(r.n for r in counts)
    below = np.cumsum(share)[:-1]
    first = np.log(below / (1 - below))
    start = np.concatenate([np.zeros(SIZE), first[:1], np.log(np.diff(first))])
    found = minimise(lambda at: _loss(data, place, at), start)
    return OrdinalModel(tuple(map(float, found[:SIZE])), tuple(map(float, thresholds(found[SIZE:]))), tuple(grades))


def thresholds(raw: np.ndarray) -> np.ndarray:
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def losses(x: np.ndarray, grade: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss of the rows of x, with grades by place, and its gradient by at: the
    weights, the first threshold and the logarithms of the gaps."""
    w, raw = at[: x.shape[1]], at[x.shape[1] :]
    cut, z = thresholds(raw), x @ w
    top, least = grade == len(cut), grade == 0
    hi = np.where(top, np.inf, cut[np.minimum(grade, len(cut) - 1)] - z)
    lo = np.where(least, -np.inf, cut[np.maximum(grade - 1, 0)] - z)
    gap = np.where(top | least, -np.inf, cut[np.minimum(grade, len(cut) - 1)] - cut[np.maximum(grade - 1, 0)])
    gap = np.where(top | least, 0.0, np.exp(-gap))
    # sigmoid(hi) - sigmoid(lo) = sigmoid(hi) * sigmoid(-lo) * (1 - exp(lo - hi))
    total = np.logaddexp(0, -hi).sum() + np.logaddexp(0, lo).sum() - np.log1p(-gap).sum()
    with np.errstate(over="ignore"):
        upper, lower = 1 / (1 + np.exp(hi)), 1 / (1 + np.exp(-lo))  # 1 - sigmoid(hi), sigmoid(lo)
    each = np.zeros(len(cut))
    np.add.at(each, grade[~top], -(upper + gap / (1 - gap))[~top])
    np.add.at(each, grade[~least] - 1, (lower + gap / (1 - gap))[~least])
    behind = np.cumsum(each[::-1])[::-1]  # a gap moves all thresholds from its own on
    return float(total), np.concatenate([x.T @ (upper - lower), behind[:1], behind[1:] * np.exp(raw[1:])])


def _loss(data: DataFrame, place: dict[int, int], at: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss of all rows plus the ridge, and the gradient."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                loss, gradient = losses(np.stack(b["x"]), b["_grade"].map(place).to_numpy(), at)
                yield pd.DataFrame([(len(b), loss, gradient)], columns=["n", "loss", "gradient"])

    parts = data.mapInPandas(part, "n long, loss double, gradient array<double>").collect()
    n = sum(p.n for p in parts)
    w = np.concatenate([at[:SIZE], np.zeros(len(at) - SIZE)])
    return sum(p.loss for p in parts) / n + RIDGE / 2 * float(w @ w), sum(np.array(p.gradient) for p in parts) / n + RIDGE * w


def minimise(f, at: np.ndarray, steps: int = STEPS, settled: float = SETTLED) -> np.ndarray:
    """The minimum of f (value and gradient) by L-BFGS with halved steps: where the gradient's
    norm is settled * max(1, value) or less. An error if it isn't reached."""
    value, g = f(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(g) <= settled * max(1.0, abs(value)):
            return at
        d, marks = -g, []
        for s, y in reversed(moves):
            a = (s @ d) / (s @ y)
            d = d - a * y
            marks.append(a)
        d = d * ((moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1e-12, np.linalg.norm(g)))
        for (s, y), a in zip(moves, reversed(marks), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        size, rounding = 1.0, 1e-14 * abs(value)
        while True:
            there = at + size * d
            after, h = f(there)
            if after <= value + 1e-4 * size * (g @ d) + rounding:
                break
            size /= 2
            if size < 1e-9:
                raise RuntimeError(f"no lower value along a step; the gradient's norm is {np.linalg.norm(g):.1e}")
        if (there - at) @ (h - g) > 1e-16:
            moves = [*moves[1 - MEMORY :], (there - at, h - g)]
        at, value, g = there, after, h
    if np.linalg.norm(g) <= settled * max(1.0, abs(value)):
        return at
    raise RuntimeError(f"not settled in {steps} steps; the gradient's norm is {np.linalg.norm(g):.1e}")


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """docs plus expected_grade and tails, the chances of each grade above the least.

    Null and empty texts are scored by the thresholds alone. Under a constant model
    expected_grade is the one grade there was (null if none) and tails is empty."""
    w, cuts, grades = np.array(model.weights), np.array(model.thresholds), np.array(model.grades)

    @F.pandas_udf("expected_grade double, tails array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            z = np.array([hashed(t) @ w for t in s])
            tails = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -500, 500)))
            expected = grades[0] + tails @ np.diff(grades) if len(grades) else np.full(len(z), None)
            yield pd.DataFrame({"expected_grade": expected, "tails": list(tails)})

    held_as = free_name(docs, "scored")
    out = docs.withColumn(held_as, scored(F.col(text)))
    return out.withColumns({n: F.col(f"{held_as}.{n}") for n in ("expected_grade", "tails")}).drop(held_as)


def select(docs: DataFrame, model: OrdinalModel, text: str = "text", grade: int = KEEP_GRADE, chance: float = KEEP_CHANCE) -> DataFrame:
    """docs plus expected_grade, tail (the chance of grade or more) and selected. Columns
    named like these, or tails, are replaced."""
    at = next((i for i, g in enumerate(model.grades[1:]) if g >= grade), None)
    # a grade no rating reaches has the chance 0, unless nothing was learnt at all
    tail = F.get("tails", F.lit(at)) if at is not None else F.lit(0.0 if len(model.grades) > 1 else 1.0)
    if model.grades and grade <= model.grades[0]:
        tail = F.lit(1.0)
    return score(docs, model, text).withColumn("tail", tail).withColumn("selected", F.col("tail") >= chance).drop("tails")


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the labelled rows: 0 poor, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality").isNotNull(),
                         F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, ratings(table(spark, sf_dir, "labels")))
    return select(docs, model).select("doc_id", "expected_grade", "tail", "selected")
