"""Repeated loads: what is read and written again, and that they equal a full load."""

import os

import pytest
from pyspark.sql import functions as F

from lagwise.operators import windows
from lagwise.sources import seasons

K = (["team"], ["day"])


def features(df):
    return df.withColumn("form", windows.rolling_mean("x", 3, *K))


def table(spark, shift=0.0):
    rows = [(2000 + i // 10, t, i, float(i * i % 7 + t) + (shift if i // 10 == 2 else 0.0)) for i in range(40) for t in range(2) if not (t == 1 and i // 10 == 1)]
    return spark.createDataFrame(rows, "season int, team int, day int, x double")


def files(path):
    return {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_changed_season(spark, tmp_path):
    raw, out, whole = (str(tmp_path / n) for n in ("raw", "out", "whole"))
    ask = (features, "season", ["team"], ["day"], 3)
    assert seasons.replace_seasons(table(spark), raw, "season") == [2000, 2001, 2002, 2003]
    assert seasons.refresh(spark, raw, out, *ask) == [2000, 2001, 2002, 2003]
    before_raw, before = files(raw), files(out)
    new = table(spark, 50.0)
    assert seasons.replace_seasons(new.where("season = 2002"), raw, "season") == [2002]
    kept = {f: t for f, t in files(raw).items() if f in before_raw}
    assert all("season=2002" in f for f in before_raw if f not in kept) and all(before_raw[f] == t for f, t in kept.items())
    # a load from 2002 on must not need the folders before it
    os.rename(f"{raw}/season=2000", str(tmp_path / "away"))
    assert seasons.refresh(spark, raw, out, *ask, since=2002) == [2002, 2003]
    again = files(out)
    assert all(again.get(f) == t for f, t in before.items() if "2000" in f or "2001" in f)
    got = sorted(map(tuple, spark.read.parquet(f"{out}/features").select("season", "team", "day", "x", "form").collect()), key=str)
    want = sorted(map(tuple, features(new).select("season", "team", "day", "x", "form").collect()), key=str)
    assert got == want
    carried = spark.read.parquet(f"{out}/carry/2003")
    assert carried.groupBy("team").count().agg(F.max("count")).first()[0] == 3


def test_odd_seasons(spark, tmp_path):
    raw = str(tmp_path / "raw")
    assert seasons.replace_seasons(table(spark).limit(0), raw, "season") == []
    with pytest.raises(ValueError):
        seasons.replace_seasons(table(spark).withColumn("season", F.lit(None).cast("int")), raw, "season")
