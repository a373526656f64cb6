"""What a task holds and what is shuffled doesn't follow the table: rows are dealt by keys
while they are narrow, and sums of many small groups are made in order of the keys."""

import re

import pytest
from pyspark.sql import functions as F

from lagwise import catalog
from lagwise.operators import ewma, models, rollups
from lagwise.plans import views as v
from lagwise.staging import UNSORTED_PARTS, dealt, parts_of


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_rows(spark):
    df = spark.range(1_000).withColumn("k", F.col("id") % 97)
    assert dealt(df, ["k"], 1_000, of=100).rdd.getNumPartitions() == 10
    assert dealt(df, ["k"], 0).rdd.getNumPartitions() == 1
    assert v.by_player(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 4


def test_parts_that_the_writer_need_not_sort():
    assert [parts_of(n, of=10) for n in (0, 95, 2_000)] == [1, 10, UNSORTED_PARTS]
    assert [parts_of(n, of=10) for n in (2_001, 19_999, 20_001)] == [UNSORTED_PARTS, UNSORTED_PARTS, UNSORTED_PARTS + 1]


def test_box_and_game_table_are_dealt_by_number(spark):
    d = "/root/testdata/sf0.1"
    for df in (v.box(spark, d), v.form(spark, d), catalog.queries()["game_table_full"](spark, d)):
        by = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), (\w+)", plan(df))
        assert by and set(by) == {("4", "REPARTITION_BY_NUM")}  # none by a setting's number or a compressed size


def test_rosters_are_summed_in_order(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (1, 4.0), (2, None), (3, float("nan")), (3, 1.0)], "g int, x double")
    out = rollups.roster_rollup(df, ["g"], {"x": ["max", "std", "mean", "sum"]}, fill_std=["x"])
    assert "SortAggregate" in plan(out) and "HashAggregate" not in plan(out)
    got = {r.g: tuple(r)[1:] for r in out.collect()}
    assert got[1] == (4.0, pytest.approx(2**0.5), 3.0, 6.0) and got[2] == (None, 0.0, None, None) and got[3][0] != got[3][0]


def test_profiles_are_sorted_and_shuffled_narrow(spark):
    got = plan(catalog.queries()["player_profiles"](spark, "/root/testdata/sf0.1"))
    assert len(re.findall("Exchange hashpartitioning", got)) == 2  # by game, by player
    assert not re.search(r"Exchange hashpartitioning\(.*true_shooting", got)


def test_means_take_two_sorts(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.rand(1).alias("x")).repartition(2, "k")
    assert len(re.findall(r"(?m)^\W*Sort \[", plan(ewma.ewma(df, {"m": "x"}, ["k"], ["o"], halflife=2, adjust=True)))) == 2


def test_paired_lines_are_those_of_box(spark):
    d = "/root/testdata/sf0.01"
    lines = v.lines(spark, d).where("paired").select("game", "team").collect()
    assert sorted(lines) == sorted(v.box(spark, d).select("game", "team").collect())


def test_components_of_large_means_and_constants(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(1e8, 1.0, 300), rng.normal(size=300), np.full(300, 7.0)])
    x[:, 1] += x[:, 0] - 1e8
    df = models.assemble(spark.createDataFrame([tuple(map(float, r)) for r in x], ["a", "b", "c"]).repartition(7), ["a", "b", "c"], "v")
    out, explained = models.pca_by(df, df, "v", 2)
    z = (x[:, :2] - x[:, :2].mean(axis=0)) / x[:, :2].std(axis=0, ddof=1)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert explained == pytest.approx(values / values.sum(), abs=1e-6)
    assert out.agg(F.var_samp("pca_1")).first()[0] == pytest.approx(values[0], rel=1e-6)
    with pytest.raises(ValueError):
        models.pca_by(df, df.limit(1), "v", 2)
