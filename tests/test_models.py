"""Models against NumPy, and their pieces."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lagwise.operators import ensemble, importance, models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(i, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "position int, label double, a double, b double, c double")
    return models.assemble(df, ["a", "b", "c"]).cache(), x, y


def test_logistic_is_ridge(data):
    df, x, y = data
    m = models.logistic(0.1, 400).fit(df)
    w, b = np.zeros(3), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        z = np.c_[x, np.ones(400)]
        g = 0.1 * z.T @ (p - y) + np.r_[w, 0]
        h = 0.1 * (z * (p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 1, 0])
        w, b = np.split(np.r_[w, b] - np.linalg.solve(h, g), [3])
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-4)


def test_pca_is_eigh(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) @ np.diag([5, 3, 2, 1, 1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>").withColumn("x", array_to_vector("v"))
    out, share = models.pca_by_train(df, "x", 2, F.col("i") < 40)
    train = x[:40]
    z = (x - train.mean(0)) / train.std(0, ddof=1)
    value, vector = np.linalg.eigh(np.cov(z[:40].T))
    axes = vector[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(2)])
    got = np.array([[r.pca_1, r.pca_2] for r in out.orderBy("i").collect()])
    assert np.allclose(got, z @ axes, atol=1e-6)
    assert share[0] == pytest.approx(value[-1] / value.sum())


def test_cv_and_search(data):
    df, _, _ = data
    found = models.expanding_cv(df, lambda p, n: models.logistic(p["c"], n), models.grid({"c": [1e-4, 1.0]}), folds=3)
    assert found[0].params == {"c": 1.0} and len(found[0].losses) == 3
    assert models.draws({"a": [1, 2, 3], "b": [1, 2]}, 4) == models.draws({"a": [1, 2, 3], "b": [1, 2]}, 4)
    assert len(models.draws({"a": [1]}, 4)) == 1


def test_calibration(data):
    df, _, _ = data
    model = models.calibrate(df, lambda n: models.logistic(0.01, n), folds=3)
    p = [r.p for r in model.transform(df).collect()]
    assert 0 <= min(p) and max(p) <= 1
    plain = models.log_loss(models.chance(df, models.logistic(0.01, 100).fit(df)))
    assert models.log_loss(model.transform(df)) < plain


def test_importance(spark, data):
    df, _, _ = data
    m = models.logistic(1.0, 400).fit(df)
    got = {r.feature: r.importance for r in importance.permutation_importance(df, m, ["a", "b", "c"], "position", repeats=5).collect()}
    assert got["a"] > 0.2 and abs(got["b"]) < 0.05 and abs(got["c"]) < 0.05
    assert models.coefficient_ranking(spark, m, ["a", "b", "c"]).first().feature == "a"
    t = models.trees(maxIter=3, maxDepth=2).fit(df)
    assert models.tree_importance(spark, t, ["a", "b", "c"]).first().feature == "a"


def test_retrain(data):
    df, _, _ = data
    split = df.drop("features").withColumn("split", F.when(F.col("position") < 300, "train").otherwise("test"))
    model = models.retrain(split, lambda: models.logistic(1.0, 300), ["a", "b", "c"])
    assert models.log_loss(models.chance(split, model)) < 0.4
    scaled = models.scale_by_train(split, ["a"]).where("split = 'train'").agg(F.avg("a"), F.stddev_pop("a")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)


def test_ridge_of_each_fold(data):
    """A fold's penalty is by its own number of rows."""
    df, x, y = data
    seen = []
    models.expanding_cv(df, lambda p, n: seen.append(n) or models.logistic(1.0, n), [{}], folds=3)
    assert sorted(seen) == [100, 200, 300]


def test_calibrated_retrain(spark, data):
    df, _, _ = data
    split = df.drop("features").withColumn("split", F.when(F.col("position") < 300, "train").otherwise("test")).withColumn("day", F.floor(F.col("position") / 10))
    out = models.retrain_calibrated(split, ["a", "b", "c"], lambda n: models.logistic(1.0, n), "day", ["position"], folds=3)
    assert out.count() == 400 and models.log_loss(out.where("split = 'test'")) < 0.4


def test_saved_model_loads(spark, data, tmp_path):
    from lagwise.sources import sinks

    df, _, _ = data
    split = df.drop("features").withColumn("split", F.lit("train"))
    model = models.retrain(split, lambda: models.logistic(1.0, 400), ["a", "b", "c"])
    sinks.save_model(model, str(tmp_path / "m"))
    again = sinks.load_model(str(tmp_path / "m"))
    assert models.log_loss(models.chance(split, again)) == pytest.approx(models.log_loss(models.chance(split, model)))


def test_saved_blend_scores_alike_in_a_new_session(spark, data, tmp_path):
    df, _, _ = data
    rows = df.drop("features").withColumn("split", F.when(F.col("position") < 200, "train").when(F.col("position") < 300, "val").otherwise("test"))
    rows = rows.withColumn("c", F.when(F.col("position") % 7 > 0, F.col("c"))).withColumn("flat", F.lit(3.0))
    makers = {"lr": lambda n: models.logistic(1.0, n), "trees": lambda n: models.trees(maxIter=2, maxDepth=2)}
    model = ensemble.fit_blend(rows, ["a", "b", "c", "flat"], makers, "position", ["position"], folds=2)
    assert sum(m.weight for m in model.members) == pytest.approx(1) and model.info["gap"] <= 1e-9
    model.write().overwrite().save(str(tmp_path / "blend"))
    model.write().overwrite().save(str(tmp_path / "blend"))
    spark.newSession()
    again = ensemble.BlendModel.load(str(tmp_path / "blend"))
    assert again.columns == model.columns and [m.name for m in again.members] == ["lr", "trees"] and again.info == model.info
    score = lambda m: {r.position: (r.p, r.p_lr, r.p_trees) for r in m.transform(rows).collect()}
    want, got = score(model), score(again)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert models.log_loss(again.transform(rows).where("split = 'test'")) < 0.5 and again.transform(rows.limit(0)).count() == 0
