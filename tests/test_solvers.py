"""Blend weights, dealt places, importance and screening against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.operators import blend, importance, models, selection, splits


def loss_of(w, p, y):
    q = np.clip(p @ np.asarray(w), 1e-15, 1 - 1e-15)
    return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(2)
    truth = rng.normal(size=900)
    y = (truth + 0.6 * rng.normal(size=900) > 0).astype(float)
    p = np.column_stack([1 / (1 + np.exp(-(s * truth + rng.normal(size=900) * e))) for s, e in ((2, 1.5), (1.5, 1), (0.1, 2), (3, 2), (1, 0.3), (0, 1))])
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(p, y, strict=True)], ", ".join(["y int", *[f"p{i} double" for i in range(6)]])).repartition(3)
    return df, p, y


def test_six_models_on_the_simplex(scores):
    df, p, y = scores
    got = blend.simplex_weights(df, "y", [f"p{i}" for i in range(6)])
    assert got.gap <= 1e-9 and got.steps > 0 and sum(got.weights) == pytest.approx(1) and min(got.weights) >= 0
    rng = np.random.default_rng(0)
    near = [np.clip(np.array(got.weights) + rng.normal(size=6) * s, 0, None) for s in (1e-4, 1e-2, 0.2) for _ in range(300)]
    assert got.loss == pytest.approx(loss_of(got.weights, p, y), abs=1e-12)
    assert all(loss_of(w / w.sum(), p, y) >= got.loss - 1e-9 for w in [*near, *np.eye(6)])


def test_three_models_like_a_fine_grid(scores):
    df, p, y = scores
    got = blend.simplex_weights(df, "y", ["p0", "p1", "p2"])
    centre, size = np.array([1 / 3, 1 / 3]), 0.5
    for _ in range(40):
        at = [centre + np.array([i, j]) * size / 4 for i in range(-4, 5) for j in range(-4, 5)]
        at = [a for a in at if a.min() >= 0 and a.sum() <= 1]
        centre = min(at, key=lambda a: loss_of([*a, 1 - a.sum()], p[:, :3], y))
        size *= 0.7
    assert abs(got.loss - loss_of([*centre, 1 - centre.sum()], p[:, :3], y)) < 1e-8


def test_blend_of_a_better_model(spark):
    df = spark.createDataFrame([(0.9, 0.85, 0.95, 1), (0.1, 0.15, 0.05, 0), (0.8, 0.7, 0.9, 1), (None, 0.1, 0.2, 1)], "a double, b double, c double, y int")
    assert blend.simplex_weights(df, "y", ["a", "b", "c"]).weights == pytest.approx((0, 0, 1), abs=1e-6)
    assert blend.simplex_weights(df.limit(0), "y", ["a", "b", "c"]).weights == pytest.approx((1 / 3,) * 3)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1001])
def test_dealt_is_a_bijection(spark, n):
    rows = spark.range(n).select("id", *[importance.dealt(F.col("id"), n, F.lit(k)).alias(f"d{k}") for k in range(2)]).collect()
    for k in range(2):
        assert sorted(r[f"d{k}"] for r in rows) == list(range(n))
    if n > 50:
        assert [r.d0 for r in rows] != [r.d1 for r in rows]
        assert sum(r.d0 == r.id for r in rows) < 10 and abs(np.corrcoef([r.id for r in rows], [r.d0 for r in rows])[0, 1]) < 0.3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    x[:, 4] = x[:, 0] + 0.5 * x[:, 4]
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.7 * rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(i, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "position int, label double, " + ", ".join(f"{c} double" for c in "abcde"))
    return models.assemble(df.repartition(3), list("abcde")).cache(), x, y


def test_importance_like_numpy(spark, data):
    df, x, y = data
    model = models.logistic(1.0, 300).fit(df)
    repeats = 3
    got = {r.feature: r.importance for r in importance.permutation_importance(df, model, list("abcde"), "position", repeats=repeats).collect()}
    w, b = model.coefficients.toArray(), model.intercept
    hit = lambda z: np.mean((z @ w + b > 0) == (y == 1))
    for j, c in enumerate("abcde"):
        drops = []
        for k in range(repeats):
            place = [r[0] for r in spark.range(300).orderBy("id").select(importance.dealt(F.col("id"), 300, F.lit(f"42:{k}"))).collect()]
            z = x.copy()
            z[:, j] = x[place, j]
            drops.append(hit(x) - hit(z))
        assert got[c] == pytest.approx(np.mean(drops), abs=1e-12)
    assert importance.permutation_importance(df.limit(0), model, ["a"], "position").first().importance is None


def newton(x, y, c):
    w = np.zeros(x.shape[1] + 1)
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.ones(x.shape[1]), 0)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), c * z.T @ (p - y) + ridge * w)
    return w


def test_screening_orders_like_refits(data):
    df, x, y = data
    bounds = splits.fold_bounds(300, 3)

    def refit(cols):
        out = []
        for a, b in bounds:
            w = newton(x[:a][:, cols], y[:a], 0.1)
            z = x[a:b][:, cols] @ w[:-1] + w[-1]
            out.append(np.mean(np.logaddexp(0, z) - y[a:b] * z))
        return np.mean(out)

    kept, gone = selection.backward_selection(df, list("abcde"), c=0.1, folds=3)
    cols, want, best = list(range(5)), [], refit(range(5))
    while len(cols) > 1:
        loss, j = min((refit([c for c in cols if c != k]), -k) for k in cols)
        if loss > best:
            break
        cols.remove(-j)
        best = loss
        want.append(("abcde"[-j], pytest.approx(loss, abs=1e-6)))
    assert gone == want and kept == ["abcde"[c] for c in cols]
    weights, found = selection.settled(df, list("abcde"), bounds, [np.zeros(6)] * 3, 0.1)
    assert np.allclose(weights[1], newton(x[: bounds[1][0]], y[: bounds[1][0]], 0.1), atol=1e-4)
    screened = selection.screened(weights, found, 0.1)
    assert np.allclose(screened, [refit([c for c in range(5) if c != k]) for k in range(5)], atol=0.02)


def test_confirmation_can_refuse(data):
    df, _, _ = data
    asked = []
    kept, gone = selection.backward_selection(df, list("abcde"), c=0.1, folds=3, confirm=lambda left: asked.append(left) or float(-len(left)))
    assert kept == list("abcde") and not gone and len(asked) == 2


def test_ridges_settled_together(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    y = (rng.random(240) < 1 / (1 + np.exp(-x @ [1.0, -0.5, 0.0]))).astype(float)
    df = models.assemble(spark.createDataFrame([(i, *map(float, r), float(l)) for i, (r, l) in enumerate(zip(x, y, strict=True))], ["position", "a", "b", "c", "label"]), ["a", "b", "c"])
    cs = [0.001, 0.1, 10.0]
    want = {r.params["c"]: r.losses for r in models.expanding_cv(df, lambda p, n: models.logistic(p["c"], n), models.grid({"c": cs}), folds=3)}
    spark.sparkContext.setJobGroup("ridges", "")
    try:
        got = selection.ridge_cv(df, ["a", "b", "c"], cs, folds=3)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ridges")) < 40  # not some for each fit
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.params["c"]: r.losses for r in got} == {c: pytest.approx(x, abs=1e-4) for c, x in want.items()}
    assert [r.loss for r in got] == sorted(r.loss for r in got)
