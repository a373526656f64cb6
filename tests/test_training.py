"""Boosted trees and networks against NumPy and MLlib."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lagwise.operators import boosting, ensemble, models, network


def rows_of(n, k, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, -1] + 0.7 * rng.normal(size=n) > 0).astype(float)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


def table_of(spark, x, y, parts=3):
    rows = [(i, float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["position", "label", "features"]).repartition(parts)


def soft(g, l1):
    return np.sign(g) * max(abs(g) - l1, 0)


def brute(x, g, h, depth, s):
    """Leaves by rows of a tree grown by trying every cut of every column."""
    worth = lambda m: soft(g[m].sum(), s.l1) ** 2 / (h[m].sum() + s.l2)
    out = np.zeros(len(x))

    def grow(m, d):
        found = (1e-9, None)
        if d:
            for f in range(x.shape[1]):
                for cut in np.unique(x[m, f][~np.isnan(x[m, f])]):
                    for missing_left in (False, True) if np.isnan(x[:, f]).any() else (False,):
                        left = m & np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= cut)
                        right = m & ~left
                        if min(h[left].sum(), h[right].sum()) >= s.least_weight:
                            gain = (worth(left) + worth(right) - worth(m)) / 2
                            if gain > found[0] + 1e-10:
                                found = (gain, (left, right))
        if found[1]:
            grow(found[1][0], d - 1)
            grow(found[1][1], d - 1)
        else:
            out[m] = -s.rate * soft(g[m].sum(), s.l1) / (h[m].sum() + s.l2)

    grow(np.ones(len(x), bool), depth)
    return out


@pytest.mark.parametrize("l1, l2, missing", [(0.0, 1.0, 0.0), (1.5, 0.0, 0.0), (0.5, 3.0, 0.2)])
def test_trees_like_brute_force(spark, l1, l2, missing):
    x, y = rows_of(120, 3, missing=missing)
    s = boosting.Settings(trees=3, depth=3, rate=0.5, l1=l1, l2=l2, bins=256)
    model = boosting.Boosted(s).fit(table_of(spark, x, y))
    score = np.full(len(x), np.log(y.sum() / (len(y) - y.sum())))
    for _ in range(3):
        p = 1 / (1 + np.exp(-score))
        score = score + brute(x, p - y, p * (1 - p), 3, s)
    assert model.margins(x) == pytest.approx(score, abs=1e-6)
    got = models.chance(model.transform(table_of(spark, x, y)).drop("probability"), model).orderBy("position").collect()
    assert [r.p for r in got] == pytest.approx(1 / (1 + np.exp(-score)), abs=1e-6)


def test_penalties_and_shares(spark):
    x, y = rows_of(600, 4, seed=3)
    df = table_of(spark, x, y)
    assert all(f < 0 for t in boosting.Boosted(trees=1, l1=1e6).fit(df).trees for f in t.feature)
    size = [max(abs(v) for t in boosting.Boosted(trees=1, depth=2, l2=l2).fit(df).trees for v in t.value) for l2 in (0.0, 10.0, 100.0)]
    assert size[0] > size[1] > size[2] > 0
    one = boosting.Boosted(trees=20, depth=2, columns=0.25, rows=0.5, rate=0.3).fit(df)
    assert all(len({f for f in t.feature if f >= 0}) <= 1 for t in one.trees) and len({f for t in one.trees for f in t.feature}) > 3
    again = boosting.Boosted(trees=20, depth=2, columns=0.25, rows=0.5, rate=0.3).fit(df.repartition(7))
    assert one.margins(x) == pytest.approx(again.margins(x), abs=1e-9)
    assert one.importances.sum() == pytest.approx(1) and one.importances[3] == one.importances.min()


def test_rows_kept_are_a_share():
    key = np.random.default_rng(0).integers(-(2**62), 2**62, 20000)
    s = boosting.Settings(rows=0.3)
    a, b = boosting._kept(key, 0, s), boosting._kept(key, 1, s)
    assert abs(a.mean() - 0.3) < 0.02 and abs((a & b).mean() - 0.09) < 0.02


def test_trees_of_odd_tables(spark):
    x, y = rows_of(12, 2)
    df = table_of(spark, x, y)
    empty = boosting.Boosted().fit(df.limit(0))
    assert models.chance(df, empty).select("p").distinct().collect()[0].p == pytest.approx(0.5)
    assert models.chance(df.limit(0), empty).count() == 0
    ones = boosting.Boosted().fit(df.withColumn("label", F.lit(1.0)))
    assert models.chance(df, ones).agg(F.min("p")).first()[0] > 0.99 and ones.trees == []
    same = boosting.Boosted(trees=2).fit(df.withColumn("features", models.array_to_vector(F.array(F.lit(1.0), F.lit(2.0)))))
    assert models.chance(df, same).agg(F.max("p") - F.min("p")).first()[0] == pytest.approx(0)


@pytest.mark.parametrize("activation", ["tanh", "relu"])
def test_gradient_like_differences(spark, activation):
    x, y = rows_of(50, 3)
    net = network.Network((5, 4), activation, l2=0.3)
    sizes = [3, 5, 4, 1]
    w = net.first_weights(sizes) + 0.05
    rows = table_of(spark, x, y).select(models.vector_to_array("features").alias("x"), F.col("label").alias("y"), F.col("position").cast("double").alias("at"))
    got = net.point(rows, sizes, 40.0, w)
    weights_only = network._decayed(sizes)

    def loss(v):
        return (network.loss_and_gradient(x[:40], y[:40], v, sizes, activation)[0] + 0.15 * (weights_only * v * v).sum()) / 40

    step = 1e-6
    near = [(loss(w + step * e) - loss(w - step * e)) / (2 * step) for e in np.eye(len(w))]
    assert got.loss == pytest.approx(loss(w), abs=1e-12) and got.gradient == pytest.approx(near, abs=1e-6)
    assert got.held == pytest.approx(network.loss_and_gradient(x[40:], y[40:], w, sizes, activation)[0] / 10, abs=1e-12)


@pytest.mark.parametrize("activation", ["tanh", "relu"])
def test_network_stops_and_is_as_good_as_another(spark, activation):
    x, y = rows_of(1500, 3, seed=5)
    df = table_of(spark, x[:1000], y[:1000])
    later = table_of(spark, x[1000:], y[1000:])
    model = network.Network((8,), activation, most=200).fit(df)
    assert model.ended in ("held back", "settled") and 3 < model.steps < 200
    other = models.perceptron(3, (8,), maxIter=100).fit(df)
    assert models.log_loss(models.chance(later, model)) <= models.log_loss(models.chance(later, other)) + 0.005


def test_network_of_odd_tables(spark):
    x, y = rows_of(6, 2)
    df = table_of(spark, x, y)
    assert models.chance(df, network.Network().fit(df.limit(0))).agg(F.max("p")).first()[0] == pytest.approx(0.5)
    assert models.chance(df.limit(0), network.Network(most=3).fit(df)).count() == 0
    with pytest.raises(ValueError):
        network.Network(activation="step")


def test_saved_blend_of_own_models(spark, tmp_path):
    x, y = rows_of(300, 3, seed=1)
    df = spark.createDataFrame([(i, "train" if i < 200 else "val", float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], ["game", "split", "label", "a", "b", "c"])
    makers = {"trees": lambda n: boosting.Boosted(trees=3, depth=2), "net": lambda n: network.Network((4,), "tanh", most=5)}
    model = ensemble.fit_blend(df, ["a", "b", "c"], makers, "game", ["game"], folds=2)
    model.write().save(str(tmp_path / "m"))
    again = ensemble.BlendModel.load(str(tmp_path / "m"))
    one, two = (m.transform(df).orderBy("game").select("p_trees", "p_net", "p").collect() for m in (model, again))
    assert one == two and 0 < one[0].p < 1


def test_calibrated_fits_read_few_parts(spark, monkeypatch):
    """What all fits pass over doesn't keep the parts of the shuffle that numbered its rows."""
    x, y = rows_of(300, 2, seed=2)
    df = spark.createDataFrame([(i, "train" if i < 200 else "val", float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], ["game", "split", "label", "a", "b"])
    seen, whole = [], models.calibrate
    for place in (models, ensemble):
        monkeypatch.setattr(place, "calibrate", lambda own, *more: seen.append(own.rdd.getNumPartitions()) or whole(own, *more))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        make = lambda n: models.logistic(0.1, n)
        out = models.retrain_calibrated(df, ["a", "b"], make, "game", ["game"], folds=2)
        model = ensemble.fit_blend(df, ["a", "b"], {"lr": make}, "game", ["game"], folds=2)
        one, two = (t.orderBy("game").select("p").collect() for t in (out, model.transform(df)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 3 and max(seen) < 20
    assert [r.p for r in one] == pytest.approx([r.p for r in two], abs=1e-6)
