"""Permutation importance without sorting rows or moving their vectors for each repeat.

A keyed bijection of 0..n-1 gives each row, for each repeat, the place from which it
receives its value. So for each feature one narrow table of places and values is joined to
the narrow list of who receives from where, and a row gets all its repeats' values as one
array. The vectors meet these arrays once, and are copied for the repeats only within the
task that scores them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.staging import stage

#: Rounds of the network, and steps back into range at most: each misses with a chance of
#: one in the root of n, so none is left outside; if one were, it would be an error.
ROUNDS, WALK = 4, 48


def dealt(place: Column, n: int, key: Column) -> Column:
    """A bijection of 0..n-1, another for each key: a Feistel network over two numbers below
    a and b with a * b >= n, whose results of n or more go through it again."""
    a = max(math.isqrt(n - 1) + 1, 1) if n > 1 else 1
    b = -(-n // a)

    def network(x: Column) -> Column:
        left, right = F.pmod(x, F.lit(a)), F.floor(x / a)
        for i in range(ROUNDS):
            if i % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(key, F.lit(i), left), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(key, F.lit(i), right), F.lit(a)), F.lit(a))
        return right * a + left

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(place.cast("long")), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a place was left out of range")).cast("long"))


def permutation_importance(df: DataFrame, model: Model, columns: Sequence[str], position: str, repeats: int = 20, seed: int = 42) -> DataFrame:
    """feature, importance: the mean drop of accuracy over repeats in which the feature's
    values are dealt to other rows.

    df has features (the columns in order), label and position, which numbers its rows from
    0 without gaps (splits.positions). An empty df has no importance: null."""
    rows = stage(df.select(F.col(position).cast("long").alias("place"), "label", vector_to_array("features").alias("x")))
    n = rows.count()
    hit = (F.col("prediction") == F.col("label")).cast("double")
    names = F.array(*map(F.lit, columns))
    if not n:
        return rows.sparkSession.createDataFrame([(c, None) for c in columns], "feature string, importance double")
    base = model.transform(rows.select("label", array_to_vector("x").alias("features"))).agg(F.avg(hit)).first()[0]
    each = rows.select(F.col("place").alias("to"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    receives = stage(each.withColumn("place", dealt(F.col("to"), n, F.concat_ws(":", F.lit(seed), "repeat"))))
    got = None
    for at in range(len(columns)):
        values = rows.select("place", F.get("x", F.lit(at)).alias("value"))
        own = receives.join(values, "place").groupBy("to").agg(F.collect_list(F.struct("repeat", "value")).alias("values")).withColumn("at", F.lit(at))
        got = own if got is None else got.unionByName(own)
    met = rows.join(got, rows["place"] == got["to"]).select("label", "x", "at", F.explode("values.value").alias("value"))
    mixed = met.withColumn("features", array_to_vector(F.transform("x", lambda v, i: F.when(i == F.col("at"), F.col("value")).otherwise(v))))
    return model.transform(mixed.select("at", "label", "features")).groupBy("at").agg((F.lit(base) - F.avg(hit)).alias("importance")).select(
        F.get(names, F.col("at")).alias("feature"), "importance")
