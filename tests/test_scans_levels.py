"""Segmented scans against windows, and replay by levels against replay in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.operators import ewma, levels, ratings, scans, windows

ORDER = (["k"], ["day", "i"])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = [(int(rng.integers(0, 3)) if rng.random() < 0.5 else 7, i // 5, i, float(rng.normal()), int(rng.random() < 0.5), None if rng.random() < 0.2 else float(rng.normal())) for i in range(2400)]
    out += [(None, i // 5, i, float(rng.normal()), int(rng.random() < 0.5), 1.0) for i in range(2400, 2460)]
    return spark.createDataFrame(out, "k int, day int, i int, x double, f int, y double").repartition(5).cache()


def close(a, b, columns, key="i"):
    a, b = ({r[key]: r for r in df.select(key, *columns).collect()} for df in (a, b))
    assert a.keys() == b.keys()
    for k in b:
        for c in columns:
            x, y = a[k][c], b[k][c]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)), (k, c)


@pytest.mark.parametrize("size", [8, 100])
def test_halo_and_runs(rows, size):
    seg = scans.cut(rows, *ORDER, "day", size=size)
    got = scans.runs(scans.halo(seg, 8, {"a": scans.rolling_mean("x", 8), "b": scans.rolling_sum("y", 5), "c": scans.ratio_of_sums("x", "y", 8), "d": scans.lagged("x", 3)}), "f")
    got = scans.running(got, {"t": (F.col("y"), F.sum), "m": (F.col("x"), F.max)}).result()
    up_to = windows.by(*ORDER).rowsBetween(-100_000, 0)
    want = rows.withColumns({"a": windows.rolling_mean("x", 8, *ORDER), "b": windows.rolling_sum("y", 5, *ORDER), "c": windows.ratio_of_sums("x", "y", 8, *ORDER),
                             "d": F.lag("x", 3).over(windows.by(*ORDER)), "run_id": windows.run_id("f", *ORDER), "t": F.sum("y").over(up_to), "m": F.max("x").over(up_to)})
    close(got, windows.run_length(want, "f", *ORDER), ["a", "b", "c", "d", "run_id", "run_length", "t", "m"])


def test_ewma(rows):
    seg = scans.cut(rows, *ORDER, "day")
    got = scans.ewma(scans.ewma(seg, {"e": "x"}, span=3), {"g": "x", "n": "y"}, halflife=20, adjust=True).result()
    want = ewma.ewma(ewma.ewma(rows, {"e": "x"}, *ORDER, span=3), {"g": "x"}, *ORDER, halflife=20, adjust=True)
    close(got, want.withColumn("n", ewma.ewma_with_nulls("y", *ORDER, halflife=20, adjust=True)), ["e", "g", "n"])
    with pytest.raises(Exception, match="adjust=True"):
        scans.ewma(seg, {"e": "y"}, span=3).result().collect()


def test_no_task_holds_more_than_a_block(rows):
    """The busiest entity has half of the rows; blocks with their halo stay small."""
    seg = scans.cut(rows, *ORDER, "day", size=50)
    places = seg.df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("lo"), F.max("_i").alias("hi"), F.countDistinct("_i").alias("d")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 and r.d == r.n for r in places) and max(r.n for r in places) > 1000
    most = scans.halo(seg, 8, {"n": lambda over: F.count(F.lit(1)).over(over.rowsBetween(-100_000, 100_000))}).df.agg(F.max("n")).first()[0]
    assert most <= 58
    with pytest.raises(ValueError):
        scans.halo(seg, 51, {})
    with pytest.raises(ValueError):
        scans.cut(rows, ["k"], [], "day")
    assert scans.runs(scans.cut(rows.limit(0), *ORDER, "day"), "f").result().count() == 0


GAME = ("game", ["day", "game"], "h", "a", "won")


@pytest.fixture(scope="module")
def games(spark):
    rng = np.random.default_rng(1)
    out = [(i, i // 6, int(a) if rng.random() > 0.02 else None, int(b), int(rng.random() < 0.5) if rng.random() > 0.05 else None) for i, (a, b) in enumerate(rng.integers(0, 12, (90, 2)))]
    return spark.createDataFrame(out, "game long, day int, h long, a long, won int").repartition(3).cache()


def replayed(df):
    return {r.game: (r.home_rating, r.away_rating) for r in df.collect()}


@pytest.fixture(scope="module")
def in_order(games):
    apart = games.withColumn("h", F.when(F.col("h") != F.col("a"), F.col("h"))).withColumn("pool", F.lit(1))
    return replayed(ratings.rating_replay(apart, "pool", ["day", "game"], "h", "a", "won"))


@pytest.mark.parametrize("wide,band", [(50_000, 200_000), (1, 9)])
def test_levels_like_in_order(games, in_order, wide, band):
    few = games.where("day < 6") if wide == 1 else games
    got = replayed(levels.replay_by_levels(few, *GAME, wide=wide, band=band)[0])
    assert got == {k: pytest.approx(v) if v[0] is not None else v for k, v in in_order.items() if k in got} and len(got) == few.count()


def test_levels_are_dependencies(games):
    found = {r.game: r for r in levels.with_levels(games, *GAME[:4]).collect()}
    last: dict = {}
    for i in sorted(found):
        r = found[i]
        if r.h is None or r.h == r.a:
            assert r.level is None
            continue
        want = 1 + max(last.get(r.h, 0), last.get(r.a, 0))
        assert r.level == want
        last[r.h] = last[r.a] = want


def test_resumed_replay(games, in_order):
    first, state = levels.replay_by_levels(games.where("day < 8"), *GAME)
    then, end = levels.replay_by_levels(games.where("day >= 8"), *GAME, state=state)
    assert replayed(first.unionByName(then)) == {k: pytest.approx(v) if v[0] is not None else v for k, v in in_order.items()}
    whole = {r.team: r.rating for r in levels.replay_by_levels(games, *GAME)[1].collect()}
    assert {r.team: r.rating for r in end.collect()} == pytest.approx(whole)
    nothing, none = levels.replay_by_levels(games.limit(0), *GAME)
    assert nothing.count() == none.count() == 0


def test_bands():
    assert levels._bands([(1, 5), (2, 3), (3, 20), (4, 2), (5, 4), (6, 7)], wide=10, band=9) == [(1, 2, False), (3, 3, True), (4, 5, False), (6, 6, False)]


@pytest.mark.parametrize("band", [7, 500_000])
def test_places_like_in_order(games, in_order, band):
    few = games.where("day < 6") if band == 7 else games
    got = replayed(levels.replay_in_bands(few, *GAME, band=band)[0])
    assert got == {k: pytest.approx(v) if v[0] is not None else v for k, v in in_order.items() if k in got} and len(got) == few.count()


def test_places_resumed(games, in_order):
    first, state = levels.replay_in_bands(games.where("day < 8"), *GAME)
    then, end = levels.replay_in_bands(games.where("day >= 8"), *GAME, state=state)
    assert replayed(first.unionByName(then)) == {k: pytest.approx(v) if v[0] is not None else v for k, v in in_order.items()}
    assert {r.team: r.rating for r in end.collect()} == pytest.approx({r.team: r.rating for r in levels.replay_by_levels(games, *GAME)[1].collect()})
    nothing, none = levels.replay_in_bands(games.limit(0), *GAME)
    assert nothing.count() == none.count() == 0


def test_places_take_few_jobs(spark):
    """A chain of games, each with a team of the one before, takes no round for each link."""
    chain = spark.createDataFrame([(i, i // 4, i, i + 1, i % 2) for i in range(300)], "game long, day int, h long, a long, won int")
    spark.sparkContext.setJobGroup("places", "")
    try:
        out, _ = levels.replay_in_bands(chain, *GAME)
        assert out.where("home_rating is null").count() == 0
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("places")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
