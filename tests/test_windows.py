"""Lagged features on hand-checked frames, and that no later row can change them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagwise.operators import ewma, features, pairs, ratings, rollups, splits, windows
from lagwise.operators.features import FeatureSpec

DAY = dt.date


def test_schedule(spark):
    rows = [("LAL", DAY(2023, 10, 24), 0), ("LAL", DAY(2023, 10, 26), 1), ("LAL", DAY(2023, 10, 27), 1)]
    df = spark.createDataFrame(rows, "team string, date date, away int")
    k = (["team"], ["date"])
    out = df.withColumns({"rest": windows.gap_days("date", *k), "b2b": windows.gap_flag("date", *k), "three": windows.density_flag("date", *k, rows=2, days=3),
                          "four": windows.density_flag("date", *k, rows=3, days=4)})
    out = windows.run_length(out, "away", *k).orderBy("date").collect()
    assert [r.rest for r in out] == [5, 2, 1]
    assert [r.b2b for r in out] == [0, 0, 1]
    assert [r.three for r in out] == [0, 0, 1]
    assert [r.four for r in out] == [0, 0, 0]
    assert [r.run_length for r in out] == [0, 1, 2]


def test_order_is_needed():
    with pytest.raises(ValueError):
        windows.by(["team"], [])


def test_ratings(spark):
    games = spark.createDataFrame([(1, 1, "LAL", "DEN", 1), (1, 2, "LAL", "DEN", 1), (1, 3, None, "DEN", 0), (2, 1, "LAL", "DEN", 0)], "pool int, game int, home string, away string, won int")
    out = {(r.pool, r.game): (r.home_rating, r.away_rating) for r in ratings.rating_replay(games, "pool", ["game"], "home", "away", "won").collect()}
    assert out[1, 1] == (1500, 1500) and out[2, 1] == (1500, 1500)
    assert out[1, 2] == (1510, 1490)
    assert out[1, 3] == (None, None)


@pytest.mark.parametrize("kw", [{"span": 3}, {"span": 10}, {"halflife": 20}])
@pytest.mark.parametrize("adjust", [False, True])
def test_ewma_like_pandas(spark, kw, adjust):
    import numpy as np
    import pandas as pd

    x = np.random.default_rng(1).normal(50, 10, 700)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, x double")
    got = [r.y for r in ewma.ewma(df, {"y": "x"}, ["k"], ["i"], adjust=adjust, **kw).orderBy("i").collect()]
    want = pd.Series(x).shift(1).ewm(adjust=adjust, min_periods=1, **kw).mean()
    assert got[0] is None and np.allclose(got[1:], want[1:], rtol=1e-12)


def test_ewma_refuses_nulls(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None)], "k int, i int, x double")
    with pytest.raises(Exception, match="ewma_with_nulls"):
        ewma.ewma(df, {"y": "x"}, ["k"], ["i"], span=3).collect()


def test_shared_blocks(spark):
    """Decays that share blocks, and ones too far apart for that, equal those on their own."""
    df = spark.createDataFrame([(i % 2, i, float(i * i % 17)) for i in range(900)], "k int, i int, x double")
    k = (["k"], ["i"])
    assert len(ewma._fitting([0.1, 0.99])) == 2 and len(ewma._fitting([ewma.keep_of(span=s) for s in (3, 5, 10)])) == 1
    for spans in ((3, 5, 10), (1.2, 400)):
        out = ewma.fan_out(df, ["x"], *k, spans=spans)
        for s in spans:
            out = ewma.ewma(out, {f"own_{s}".replace(".", "_"): "x"}, *k, span=s)
        for r in out.where("i > 1").collect():
            assert all(r[f"x_ewma_{s}"] == pytest.approx(r[f"own_{s}".replace(".", "_")]) for s in spans)


def test_sides_from_text(spark):
    rows = [(1, 1, "AAA vs. BBB"), (1, 2, "BBB @ AAA"), (2, 1, "AAA @ CCC"), (2, 2, "CCC vs. AAA"), (3, 1, "AAA ? DDD"), (3, 2, "DDD ? AAA"), (4, 1, None), (4, 2, "x"), (5, 1, "AAA vs. EEE")]
    df = spark.createDataFrame(rows, "game int, row int, matchup string")
    got = {(r.game, r.row): r.home for r in pairs.home_flag(df, "game", "matchup", ["row"]).collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): False, (2, 2): True, (3, 1): False, (3, 2): True, (4, 1): False, (4, 2): True}
    assert df.select(pairs.opponent_code("matchup")).first()[0] == "BBB"


def test_ewma_with_nulls_like_pandas(spark):
    import numpy as np
    import pandas as pd

    x = [1.0, None, 4.0, None, None, 2.0, 8.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i int, x double")
    for adjust in (False, True):
        got = [r.y for r in df.withColumn("y", ewma.ewma_with_nulls("x", ["k"], ["i"], span=3, adjust=adjust)).orderBy("i").collect()]
        want = pd.Series(x, dtype=float).ewm(span=3, adjust=adjust).mean().shift(1)
        assert got[0] is None and np.allclose(got[1:], want[1:])


@pytest.mark.parametrize("feature", ["mean", "sum", "ewma", "fan", "z"])
def test_nothing_leaks(spark, feature):
    def run(values):
        df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, i int, x double")
        k = (["k"], ["i"])
        out = {"mean": lambda: df.withColumn("y", windows.rolling_mean("x", 3, *k)), "sum": lambda: df.withColumn("y", windows.rolling_sum("x", 3, *k)),
               "ewma": lambda: ewma.ewma(df, {"y": "x"}, *k, span=3), "fan": lambda: ewma.fan_out(df, ["x"], *k).withColumn("y", F.col("x_ewma_5")),
               "z": lambda: df.withColumn("z", windows.expanding_zscore("x", *k)).withColumn("y", F.col("z") * 0 + F.lag("z").over(windows.by(*k)))}[feature]()
        return [r.y for r in out.orderBy("i").collect()]

    a, b = run([3, 1, 4, 1, 5, 9]), run([3, 1, 4, 100, 5, 9])
    assert a[:4] == b[:4]


def test_zscore_of_constant_and_single(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 7.0)], "g string, x double")
    assert [r.z_x for r in windows.group_zscore(df, ["g"], ["x"]).collect()] == [0, 0, 0]


def test_pair_forms_agree(spark):
    rows = [(1, True, 10), (1, False, 7), (2, True, 1), (3, False, 2), (3, False, 3)]
    df = spark.createDataFrame(rows, "game int, home boolean, pts int")
    assert pairs.pair_up(df, "game", "home", ["pts"]).collect() == [(1, 10, 7)]
    assert pairs.pair_join(pairs.only_pairs(df, "game"), "game", "home", ["pts"]).collect() == [(1, 10, 7)]
    assert pairs.deltas(pairs.pair_up(df, "game", "home", ["pts"]), ["pts"]).first().delta_pts == 3


def test_rollup_fill_order(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 2, 4.0)], "game int, team int, x double")
    out = {r.team: r for r in rollups.roster_rollup(df, ["game", "team"], {"x": ["sum", "std"]}).collect()}
    assert out[1].std_x is None and out[2].sum_x == 6
    assert rollups.roster_rollup(df, ["game", "team"], {"x": ["std"]}, fill_std=["x"]).where("team = 1").first().std_x == 0


def test_splits_are_disjoint_and_whole(spark):
    df = spark.createDataFrame([(f"2{y}",) for y in range(2017, 2023)], "season string")
    out = df.withColumn("split", splits.chrono_split("season", "22018", "22020"))
    assert {r.split: r.n for r in rollups.split_counts(out).collect()} == {"train": 2, "val": 2, "test": 2}


def test_folds():
    assert splits.fold_bounds(12, 5) == [(2, 4), (4, 6), (6, 8), (8, 10), (10, 12)]
    with pytest.raises(ValueError):
        splits.fold_bounds(3, 5)


def test_feature_selection(spark):
    df = spark.createDataFrame([(1, 2.0, 3, "x", 1, 2.0)], "home_a int, delta_b double, rest int, home_id string, home_win int, delta_z_c double")
    assert features.select_features(df.schema, FeatureSpec(("home_", "delta_"), ("rest", "delta_b"), without=("_z_",))) == ["home_a", "delta_b", "rest"]
    assert features.drop_side_columns(df, ["a"]).columns == df.columns[1:]


def test_partitions_do_not_matter(spark, sf):
    from lagwise.catalog import queries

    q = queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("ewma_span5", "rating_replay", "roc_auc", "expanding_folds", "stable_sample"):
            got = []
            for n in ("1", "8"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                got.append(sorted(map(str, q[name](spark, sf).collect())))
            assert got[0] == got[1], name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
