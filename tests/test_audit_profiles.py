"""The audit for leaks on the library's features and on planted leaks, and the chain from
profiles to components against NumPy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lagwise.operators import audit, ewma, profiles, windows

K = (["team"], ["day", "game"])
LIBRARY = ["mean", "sum", "ewma", "x_rolling_8", "x_ewma_5", "twice", "ratio", "gap", "z"]


@pytest.fixture(scope="module")
def games(spark):
    rng = np.random.default_rng(4)
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(days=int(i // 2)), i * 10 + t, float(rng.integers(60, 120)), 1.0 + i) for i in range(40) for t in range(3)]
    return spark.createDataFrame(rows, "team int, day date, game int, x double, n double")


def library(df):
    out = df.withColumns({"mean": windows.rolling_mean("x", 5, *K), "sum": windows.rolling_sum("x", 5, *K), "ratio": windows.ratio_of_sums("x", "n", 4, *K),
                          "gap": windows.gap_days("day", *K), "own_z": windows.expanding_zscore("x", *K)})
    out = out.withColumn("z", F.lag("own_z").over(windows.by(*K)))
    out = ewma.fan_out(ewma.ewma(out, {"ewma": "x"}, *K, span=4), ["x"], *K, spans=(5,))
    return out.withColumn("twice", ewma.ewma_with_nulls("ewma", *K, span=3)).drop("x", "n")


def changed(rows):
    total = {}
    for r in rows:
        total[r.feature] = total.get(r.feature, 0) + r.n_changed
    return total


def test_library_leaks_nothing(games):
    rows = audit.leak_audit(games, library, ["team", "game"], ["day", "game"], ["x"], [*LIBRARY, "own_z"], cuts=4).collect()
    # a score of the row's own value against earlier rows is no feature before it is lagged
    assert changed(rows) == dict.fromkeys(LIBRARY, 0) | {"own_z": 4}
    assert all(r.n_rows > 0 for r in rows)


def test_planted_leaks_are_found(games):
    def leaking(df):
        # the row's own outcome, the next row, all rows
        out = library(df.withColumn("kept", F.col("x")))
        over = windows.by(*K)
        return out.withColumns({"unlagged": F.avg("kept").over(over.rowsBetween(-3, 0)), "next": F.lead("kept").over(over), "all": F.avg("kept").over(Window.partitionBy("team"))})

    cut = (dt.date(2020, 1, 11), 201)
    rows = audit.leak_audit(games, leaking, ["team", "game"], ["day", "game"], ["x"], ["unlagged", "next", "all", "mean"], cuts=[cut]).collect()
    total = changed(rows)
    up_to = games.where((F.col("day") < cut[0]) | (F.col("day") == cut[0]) & (F.col("game") <= cut[1])).count()
    assert {r.n_rows for r in rows} == {up_to} and total["mean"] == 0
    assert total["unlagged"] == 1 and total["all"] == up_to
    assert total["next"] == 4  # each team's last row, and the row before the blanked one


def test_audit_of_odd_tables(games):
    ask = (["team", "game"], ["day", "game"], ["x"], ["mean"])
    assert audit.leak_audit(games.limit(0), library, *ask).count() == 0
    assert audit.leak_audit(games.limit(2), library, *ask, cuts=9).count() == 2
    # a maker that loses rows when later ones are gone is caught
    lossy = lambda df: library(df).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("team"))).where("n = 40")
    assert sum(r.n_changed for r in audit.leak_audit(games, lossy, *ask, cuts=[(dt.date(2020, 1, 5), 99)]).collect()) > 0


def test_components_like_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, len(profiles.COLUMNS))) @ rng.normal(size=(len(profiles.COLUMNS),) * 2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *profiles.COLUMNS])
    got, explained = profiles.embed(df, F.col("i") < 50)
    got = np.array([[r[f"embed_{k}"] for k in range(1, 5)] for r in got.orderBy("i").collect()])
    z = (x - x[:50].mean(axis=0)) / x[:50].std(axis=0, ddof=1)
    values, axes = np.linalg.eigh(np.cov(z[:50].T))
    axes = axes[:, ::-1][:, :4]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(4)])
    assert got == pytest.approx(z @ axes, abs=1e-6) and explained == pytest.approx(values[::-1][:4] / values.sum())
    far = df.withColumns({c: F.when(F.col("i") >= 50, F.col(c) * 100).otherwise(F.col(c)) for c in profiles.COLUMNS})
    same = np.array([[r[f"embed_{k}"] for k in range(1, 5)] for r in profiles.embed(far, F.col("i") < 50)[0].where("i < 50").orderBy("i").collect()])
    assert same == pytest.approx(got[:50], abs=1e-6)


def test_profiles_of_nulls_and_repeats(spark):
    base = {c: 4.0 for c in profiles.COUNTS}
    rows = [{"p": 1, "d": dt.date(2020, 1, i + 1), "k": k, "minutes": m, **base, "pts": v} for i, k, m, v in ((0, 0, 10.0, 99.0), (0, 1, 10.0, 20.0), (1, 0, 4.0, 8.0), (2, 0, None, None))]
    df = spark.createDataFrame(rows, ", ".join(["p int", "d date", "k int", "minutes double", *[f"{c} double" for c in profiles.COUNTS]]))
    got = {r.d.day: r.pts_rate for r in profiles.profiles(df, "p", "d", ["k"]).collect()}
    q = 2 ** (-1 / 20)
    assert got == {2: pytest.approx(2.0), 3: pytest.approx((0.0 + 2.0 * q) / (1 + q))}
    assert profiles.profiles(df.limit(0), "p", "d", ["k"]).count() == 0
