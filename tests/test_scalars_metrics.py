"""Scalar functions, metrics, blends, sources and sinks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.functions import scalars as sc
from lagwise.operators import blend, metrics
from lagwise.sources import sinks, tables


def test_minutes(spark):
    df = spark.createDataFrame([("34:30",), ("34",), ("abc",), (None,), (":30",), ("nan",), ("inf:1",), ("",)], "m string")
    got = [r[0] for r in df.select(sc.parse_minutes("m")).collect()]
    assert got == pytest.approx([34.5, 34, 0, 0, 0.5, 0, 1 / 60, 0])


def test_zero_denominators(spark):
    df = spark.createDataFrame([(5.0, 0.0, 0.0, 0.0, None)], "pts double, fga double, fta double, tov double, m double")
    got = df.select(sc.true_shooting("pts", "fga", "fta"), sc.effective_goals("pts", "pts", "fga"), sc.turnover_rate("tov", "fga", "fta"),
                    sc.ratio("pts", "m"), sc.per_minute("pts", "m"), sc.usage("fga", "fta", "tov", "m")).first()
    assert list(got) == [0] * 6


def test_season_year(spark):
    assert spark.range(1).select(sc.season_year(F.lit("22018")), sc.season_year(F.lit("x"))).first()[:] == (2018, None)


def test_auc_with_ties_and_edges(spark):
    rows = [(1, 0.0), (0, 0.0), (1, 0.1), (0, 0.1), (1, 1.0), (0, 0.5), (1, 0.5), (0, 1.0), (1, 0.7)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics.roc_auc(df, "y", "p").first().auc == pytest.approx(want)
    flipped = df.select((1 - F.col("y")).alias("y"), (1 - F.col("p")).alias("p"))
    assert metrics.roc_auc(flipped, "y", "p").first().auc == pytest.approx(want)
    assert metrics.roc_auc(df.where("y = 1"), "y", "p").first().auc is None


def test_bins(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 0.10001), (0, 0.3), (1, 0.7), (1, 1.0)], "y int, p double")
    assert sorted(r.bin for r in metrics.calibration_bins(df, "y", "p").collect()) == [0, 1, 2, 6, 9]


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "y int, p double")
    assert metrics.binary_metrics(df, "y", "p").first().log_loss == pytest.approx(-math.log(1e-15) / 2, rel=1e-6)


def test_best_weights(spark):
    df = spark.createDataFrame([(0.9, 0.85, 0.95, 1), (0.1, 0.15, 0.05, 0), (0.8, 0.7, 0.9, 1)], "a double, b double, c double, y int")
    w = blend.best_weights(df, "y", ["a", "b", "c"], steps=10, refine=1)
    assert w == pytest.approx((0, 0, 1)) and sum(w) == pytest.approx(1)
    assert blend.best_weights(df.limit(0), "y", ["a", "b", "c"]) == pytest.approx((1 / 3,) * 3)
    assert len(blend.simplex(3, 100)) == 5151


def test_sources(spark, tmp_path):
    with pytest.raises(tables.MissingStage, match="run fetch first"):
        tables.read_table(spark, str(tmp_path / "none"), stage="fetch")
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path), form="csv")
    df = spark.createDataFrame([("0012", "2023-01-02", "22018", 3)], "game_id string, game_date string, season_id string, pts int")
    for form in ("csv", "json", "orc", "parquet"):
        path = str(tmp_path / form)
        sinks.write_dataset(df, path, form)
        assert tables.read_table(spark, path, df.schema, form).collect() == df.collect()
    sinks.write_dataset(df.withColumn("season", F.lit("2018-19")), str(tmp_path / "s"), by=("season",))
    assert tables.read_seasons(spark, str(tmp_path / "s")).first().season == "2018-19"
    got = tables.load_games(df, ids=["game_id"]).first()
    assert got.game_date == dt.date(2023, 1, 2) and got.season_year == 2018 and got.game_id == "0012"
    assert tables.union_seasons([df, df.drop("pts")]).where("pts is null").count() == 1


def test_seasons(spark):
    assert [r.season for r in tables.season_list(spark, "2001-09-30").collect()] == ["2000-01"]
    assert [r.season for r in tables.season_list(spark, "2001-10-01").collect()] == ["2000-01", "2001-02"]
    assert tables.season_list(spark, "1999-12-31", 1999).first().season == "1999-00"


def test_records(spark, tmp_path):
    record = {"run": {"seed": np.int32(7), "share": np.float32(0.25), "ok": np.bool_(True)}, "bounds": np.array([[1999, 2004], [2005, 2010]]), "none": np.array([]),
              "models": {"trees", "lr"}, "gap": None, "from": dt.date(2020, 1, 1), "pair": (np.float64(0.5), "x")}
    sinks.write_record(spark, record, str(tmp_path / "r"))
    assert sinks.read_record(spark, str(tmp_path / "r")) == {"run": {"seed": 7, "share": 0.25, "ok": True}, "bounds": [[1999, 2004], [2005, 2010]], "none": [],
                                                             "models": ["lr", "trees"], "gap": None, "from": "2020-01-01", "pair": [0.5, "x"]}
    assert sinks.run_path("x/", dt.datetime(2020, 1, 2, 3, 4, 5)) == "x/run_20200102_030405"
    m = {r.model: r for r in sinks.metrics_table(spark, {"lr": {"auc": 0.7}, "mlp": {"brier": 0.2}}).collect()}
    assert m["lr"].auc == 0.7 and m["lr"].brier is None


def test_report_and_search_results(spark, tmp_path):
    from lagwise.operators.models import Result

    out = sinks.report(sinks.metrics_table(spark, {"lr": {"accuracy": 0.67349, "auc": 0.72351}})).first()
    assert (out.accuracy, out.auc) == (67.3, 0.724)
    found = [Result({"c": np.float64(0.1)}, [0.5, 0.6]), Result({"c": 1.0}, [0.7, 0.8])]
    sinks.write_search(spark, found, str(tmp_path / "s"))
    assert sinks.read_record(spark, str(tmp_path / "s" / "best_params")) == {"c": 0.1}
    assert spark.read.parquet(str(tmp_path / "s" / "cv_results")).where("rank = 1 and fold = 1").first().log_loss == 0.8
