"""Weights of a blend of models that make the least log loss."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROWS_AT_ONCE = 2_048


def simplex(parts: int, steps: int) -> list[tuple[int, ...]]:
    """All tuples of so many whole numbers that add up to steps."""
    if parts == 1:
        return [(steps,)]
    return [(i, *rest) for i in range(steps + 1) for rest in simplex(parts - 1, steps - i)]


def blend_losses(df: DataFrame, label: str, scores: Sequence[str], points: Sequence[tuple[float, ...]]) -> DataFrame:
    """w1, w2, ... and log_loss for each of the stated points; rows with a null label or
    score are left out.

    Each batch of rows is multiplied by all points at once in NumPy; what is shuffled is
    one sum per point and batch."""
    names = [f"w{i + 1}" for i in range(len(scores))]
    grid = np.array(points, float).reshape(-1, len(names)).T

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.dropna()
            total = np.zeros(grid.shape[1])
            for at in range(0, len(b), _ROWS_AT_ONCE):
                y, *p = (b[c].to_numpy()[at : at + _ROWS_AT_ONCE] for c in b.columns)
                q = np.clip(np.stack(p, axis=1) @ grid, 1e-15, 1 - 1e-15)
                total -= y @ np.log(q) + (1 - y) @ np.log1p(-q)
            yield pd.DataFrame({"_at": np.arange(len(total)), "_sum": total, "_n": len(b)})

    rows = df.select(F.col(label).cast("double").alias("_y"), *[F.col(s).cast("double").alias(f"_p{i}") for i, s in enumerate(scores)])
    found = rows.mapInPandas(sums, "_at int, _sum double, _n long").groupBy("_at").agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("log_loss"))
    each = F.get(F.array(*[F.struct(*[F.lit(float(w)).alias(n) for n, w in zip(names, p, strict=True)]) for p in points]), F.col("_at"))
    return found.select(each.alias("_w"), "log_loss").select("_w.*", "log_loss")


def best_weights(df: DataFrame, label: str, scores: Sequence[str], steps: int = 20, refine: int = 2) -> tuple[float, ...]:
    """The weights of least log loss: a grid over the simplex, then finer grids about the
    best point (the loss is convex). Equal weights if there are no rows."""
    parts = len(scores)
    points = [tuple(i / steps for i in t) for t in simplex(parts, steps)]
    size = 1.0 / steps
    best: tuple[float, ...] = tuple(1 / parts for _ in scores)
    for _ in range(refine + 1):
        names = [F.col(f"w{i + 1}") for i in range(parts)]
        top = blend_losses(df, label, scores, points).where("log_loss is not null").orderBy(F.round("log_loss", 12), *[n.desc() for n in names]).limit(1).collect()
        if not top:
            return best
        best = tuple(top[0][f"w{i + 1}"] for i in range(parts))
        size /= 5
        near = [tuple(b + (x - 5) * size for b, x in zip(best, t, strict=False)) for t in _cube(parts - 1, 11)]
        points = [(*t, 1 - sum(t)) for t in near if min(t, default=0) >= -1e-12 and sum(t) <= 1 + 1e-12]
    return best


@dataclass(frozen=True)
class Blend:
    weights: tuple[float, ...]
    loss: float
    #: No point of the simplex has a loss lower by more than this.
    gap: float
    steps: int


def _at(df: DataFrame, label: str, scores: Sequence[str], w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Mean log loss at the weights w, its gradient and its matrix of second derivatives, and
    the number of rows, all summed in Spark in one job."""
    k = len(scores)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 + k + k * k), 0
        for b in batches:
            b = b.dropna()
            for at in range(0, len(b), _ROWS_AT_ONCE):
                y, *p = (b[c].to_numpy()[at : at + _ROWS_AT_ONCE] for c in b.columns)
                p = np.stack(p, axis=1)
                q = np.clip(p @ w, 1e-15, 1 - 1e-15)
                slope, bend = -y / q + (1 - y) / (1 - q), y / q**2 + (1 - y) / (1 - q) ** 2
                total += np.concatenate([[-(y @ np.log(q) + (1 - y) @ np.log1p(-q))], p.T @ slope, ((p * bend[:, None]).T @ p).ravel()])
            n += len(b)
        yield pd.DataFrame({"at": np.arange(len(total)), "sum": total, "n": n})

    rows = df.select(F.col(label).cast("double").alias("_y"), *[F.col(s).cast("double").alias(f"_p{i}") for i, s in enumerate(scores)])
    found = rows.mapInPandas(sums, "at int, sum double, n long").groupBy("at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).orderBy("at").collect()
    n = found[0].n if found else 0
    x = np.array([r.sum for r in found]) / max(n, 1) if n else np.zeros(1 + k + k * k)
    return float(x[0]), x[1 : 1 + k], x[1 + k :].reshape(k, k), n


def _quadratic(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The step d of least g.d + d.h.d / 2 for which w + d is on the simplex, by active sets."""
    k, d = len(w), np.zeros(len(w))
    free = w > 0
    h = h + 1e-12 * (np.trace(h) / k + 1e-300) * np.eye(k)
    for _ in range(20 * k):
        f = np.flatnonzero(free)
        kkt = np.zeros((len(f) + 1, len(f) + 1))
        kkt[:-1, :-1], kkt[:-1, -1], kkt[-1, :-1] = h[np.ix_(f, f)], 1, 1
        right = np.append(-(g + h @ d)[f], 0.0)
        *move, price = np.linalg.lstsq(kkt, right, rcond=None)[0]
        move = np.array(move)
        room = w[f] + d[f]
        falling = move < -1e-15
        share = np.min(room[falling] / -move[falling], initial=1.0)
        d[f] += share * move
        if share < 1:
            out = f[falling][np.argmin(room[falling] / -move[falling])]
            d[out], free[out] = -w[out], False
            continue
        rest = np.flatnonzero(~free)
        worth = (g + h @ d)[rest] + price
        if not len(rest) or worth.min() >= -1e-13:
            break
        free[rest[np.argmin(worth)]] = True
    return d


def simplex_weights(df: DataFrame, label: str, scores: Sequence[str], tolerance: float = 1e-9, most: int = 60) -> Blend:
    """The weights of least log loss for any number of scores, with a proof of it.

    The loss is convex in the weights. Each step is the best one of the loss's quadratic
    form on the simplex, halved until the loss falls; losses at all lengths come from one
    job. It ends when the gradient shows that no point of the simplex is better by more than
    tolerance, and is an error if that takes more than `most` steps. Rows with a null are
    left out; without rows the weights are equal."""
    k = len(scores)
    w = np.full(k, 1 / k)
    df = df.select(label, *scores).persist()
    try:
        for step in range(most):
            loss, g, h, n = _at(df, label, scores, w)
            if not n:
                return Blend(tuple(w.tolist()), float("nan"), float("nan"), 0)
            gap = float(g @ w - g.min())
            if gap <= tolerance:
                return Blend(tuple(w.tolist()), loss, gap, step)
            d = _quadratic(g, h, w)
            points = [np.clip(w + d / 2**i, 0, None) for i in range(12)]
            points += [w + (np.eye(k)[g.argmin()] - w) / 4**i for i in range(1, 9)]
            points = [tuple((x / x.sum()).tolist()) for x in points]
            tried = {tuple(r[f"w{i + 1}"] for i in range(k)): r["log_loss"] for r in blend_losses(df, label, scores, points).collect()}
            best = min(points, key=lambda x: tried[x])
            if tried[best] > loss:  # nothing is left but rounding
                return Blend(tuple(w.tolist()), loss, gap, step)
            w = np.array(best)
    finally:
        df.unpersist()
    raise RuntimeError(f"the weights did not settle in {most} steps: {gap} may be left")


def _cube(parts: int, n: int) -> list[tuple[int, ...]]:
    return [()] if not parts else [(i, *rest) for i in range(n) for rest in _cube(parts - 1, n)]
