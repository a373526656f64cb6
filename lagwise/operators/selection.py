"""Backward selection by screening: of each step, the loss without each column comes from
one Hessian a fold, summed in Spark, instead of a fit for each.

Ridge logistic regressions of all expanding folds are kept at their optimum. With the
Hessian H of a fold's penalised loss, leaving out column j moves its weights by
-w_j H^-1 e_j / (H^-1)_jj (the Schur complement's solution), and the loss on the rows that
the fold validates changes by its own gradient and Hessian along that move. So one job gives
all that a step's candidates need; the column that goes is then left out of every fold by
Newton steps from there, of which one or two settle it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import Result
from .splits import fold_bounds

_ROWS_AT_ONCE = 2_048


@dataclass
class Sums:
    """Loss, gradient and Hessian over rows, of the weights and at last the intercept."""

    n: int
    loss: float
    gradient: np.ndarray
    hessian: np.ndarray


def fold_sums(df: DataFrame, columns: Sequence[str], bounds: list[tuple[int, int]], weights: Sequence[np.ndarray]) -> list[tuple[Sums, Sums]]:
    """For each fold, at its own weights, the sums over the rows that it trains on and over
    those that it validates. df has position, label and the columns, nulls being 0. One job;
    what is shuffled is one sum for each number and task."""
    k = len(columns) + 1
    size = 2 + k + k * k

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(bounds), 2, size))
        for b in batches:
            place, label = b["_place"].to_numpy(), b["_y"].to_numpy()
            x = np.column_stack([b[[f"_x{i}" for i in range(k - 1)]].to_numpy(float), np.ones(len(b))])
            for at in range(0, len(b), _ROWS_AT_ONCE):
                part = slice(at, at + _ROWS_AT_ONCE)
                for f, ((first, last), w) in enumerate(zip(bounds, weights, strict=True)):
                    z = x[part] @ w
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    loss = np.logaddexp(0, z) - label[part] * z
                    for side, rows in enumerate((place[part] < first, (place[part] >= first) & (place[part] < last))):
                        if rows.any():
                            own = x[part][rows]
                            bend = (p * (1 - p))[rows]
                            total[f, side] += np.concatenate([[rows.sum(), loss[rows].sum()], own.T @ (p - label[part])[rows], ((own * bend[:, None]).T @ own).ravel()])
        flat = total.ravel()
        used = np.flatnonzero(flat)
        yield pd.DataFrame({"at": used, "sum": flat[used]})

    rows = df.select(F.col("position").alias("_place"), F.col("label").cast("double").alias("_y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(columns)])
    flat = np.zeros(len(bounds) * 2 * size)
    for r in rows.mapInPandas(sums, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():
        flat[r["at"]] = r["sum"]
    out = []
    for both in flat.reshape(len(bounds), 2, size):
        out.append(tuple(Sums(int(s[0]), float(s[1]), s[2 : 2 + k], s[2 + k :].reshape(k, k)) for s in both))
    return out


def _penalised(s: Sums, w: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of half the squared weights plus c times the loss; the intercept is free."""
    ridge = np.append(np.ones(len(w) - 1), 0.0)
    return c * s.gradient + ridge * w, c * s.hessian + np.diag(ridge)


def settled(df: DataFrame, columns: Sequence[str], bounds, weights: list[np.ndarray], c: float | Sequence[float], most: int = 30) -> tuple[list[np.ndarray], list[tuple[Sums, Sums]]]:
    """Each fold's optimum by Newton steps from weights, all folds in one job a step; an
    error if the gradients don't fall under a millionth of their rows. c is one number or one for each of bounds."""
    cs = [c] * len(bounds) if isinstance(c, (int, float)) else list(c)
    for _ in range(most):
        found = fold_sums(df, columns, bounds, weights)
        steps = [_penalised(train, w, one) for (train, _), w, one in zip(found, weights, cs, strict=True)]
        if all(np.abs(g).max() <= 1e-6 * max(one * train.n, 1) for (g, _), (train, _), one in zip(steps, found, cs, strict=True)):
            return weights, found
        moves = [np.linalg.solve(h, g) for g, h in steps]
        # a long step is cut: the loss bends less further out
        weights = [w - m * min(1.0, 5.0 / (np.abs(m).max() + 1e-300)) for w, m in zip(weights, moves, strict=True)]
    raise RuntimeError(f"the fits did not settle in {most} steps")


def _without(j: int, w: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """How the optimum moves when column j is left out."""
    return -w[j] * inverse[:, j] / inverse[j, j]


def screened(weights: list[np.ndarray], found: list[tuple[Sums, Sums]], c: float) -> np.ndarray:
    """The mean validation log loss over the folds without each column."""
    losses = []
    for w, (train, val) in zip(weights, found, strict=True):
        inverse = np.linalg.inv(_penalised(train, w, c)[1])
        moves = [_without(j, w, inverse) for j in range(len(w) - 1)]
        losses.append([(val.loss + val.gradient @ d + d @ val.hessian @ d / 2) / max(val.n, 1) for d in moves])
    return np.mean(losses, axis=0)


def backward_selection(df: DataFrame, columns: Sequence[str], c: float = 0.1, folds: int = 5, least: int = 1,
                       confirm: Callable[[list[str]], float] | None = None) -> tuple[list[str], list[tuple[str, float]]]:
    """Columns that stay when, step by step, the one without which the validation loss is
    least goes, as long as that loss gets no worse; and what went, with the loss then (of
    the settled fits, not the screened one). confirm, if given, is a slower loss of the
    columns left, such as that of recalibrated folds, which must not get worse either.

    df has position (from 0), label and the columns, which should be of one scale; c weighs
    the summed loss against half the squared weights. Ties go to the later column."""
    df = df.select("position", "label", *columns).persist()
    try:
        bounds = fold_bounds(df.count(), folds)
        kept, gone = list(columns), []
        weights, found = settled(df, kept, bounds, [np.zeros(len(kept) + 1)] * folds, c)
        best = float(np.mean([val.loss / max(val.n, 1) for _, val in found]))
        sure = confirm(kept) if confirm else None
        while len(kept) > least:
            each = screened(weights, found, c)
            j = len(each) - 1 - int(np.argmin(each[::-1]))
            left = kept[:j] + kept[j + 1 :]
            start = []
            for w, (train, _) in zip(weights, found, strict=True):
                start.append(np.delete(w + _without(j, w, np.linalg.inv(_penalised(train, w, c)[1])), j))
            tried, sums = settled(df, left, bounds, start, c)
            loss = float(np.mean([val.loss / max(val.n, 1) for _, val in sums]))
            if loss > best:
                break
            if confirm:
                again = confirm(left)
                if again > sure:
                    break
                sure = again
            gone.append((kept[j], loss))
            best, kept, weights, found = loss, left, tried, sums
        return kept, gone
    finally:
        df.unpersist()


def ridge_cv(df: DataFrame, columns: Sequence[str], cs: Sequence[float], folds: int = 5) -> list[Result]:
    """models.expanding_cv of ridge logistic regressions over their c. All folds of all c
    take their Newton steps in the same jobs, so these don't grow with the candidates; the
    losses are those of the settled fits."""
    df = df.select("position", "label", *columns).persist()
    try:
        bounds = fold_bounds(df.count(), folds)
        _, found = settled(df, columns, bounds * len(cs), [np.zeros(len(columns) + 1)] * (folds * len(cs)), [c for c in cs for _ in bounds])
    finally:
        df.unpersist()
    losses = [val.loss / max(val.n, 1) for _, val in found]
    return sorted((Result({"c": c}, losses[i * folds : (i + 1) * folds]) for i, c in enumerate(cs)), key=lambda r: r.loss)
