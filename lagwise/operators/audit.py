"""An audit for leaks: features made again without what came later.

At each of some cuts the table is cut after a moment, the outcomes of the moment's own rows
are blanked, and the features are made again. No row up to the cut may change: one that
does has seen a later row, or its own outcome."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import scratch, stage


def moments(df: DataFrame, order: Sequence[str], n: int) -> list[tuple]:
    """n moments of the table, dealt by a hash; all of them if there are fewer."""
    key = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order]))
    return [tuple(r) for r in df.select(*order).dropna().distinct().orderBy(key, *order).limit(n).collect()]


def _up_to(order: Sequence[str], cut: tuple) -> Column:
    return F.struct(*order) <= F.struct(*[F.lit(v).alias(c) for c, v in zip(order, cut, strict=True)])


def without_later(df: DataFrame, order: Sequence[str], cut: tuple, outcomes: Sequence[str]) -> DataFrame:
    """The rows up to the cut; those at it have 0 in each outcome."""
    at = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(order, cut, strict=True)])
    return df.where(_up_to(order, cut)).withColumns({c: F.when(at, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in outcomes})


def _differ(a: Column, b: Column, kind: T.DataType, tolerance: float) -> Column:
    if not isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return ~a.eqNullSafe(b)
    near = F.abs(a - b) <= tolerance * (1 + F.abs(a))
    return ~(a.eqNullSafe(b) | F.coalesce(near, F.lit(False)))


def leak_audit(df: DataFrame, features: Callable[[DataFrame], DataFrame], keys: Sequence[str], order: Sequence[str], outcomes: Sequence[str], columns: Sequence[str],
               cuts: int | Sequence[tuple] = 5, tolerance: float = 1e-9) -> DataFrame:
    """A row for each cut and column: cut (its number), feature, n_rows up to the cut and
    n_changed among them.

    features makes columns and keeps keys and order; keys name a row, without nulls; order
    says when it was, as a struct of these columns compares; outcomes, numbers, are known
    only after a row's event. cuts are moments or how many to deal. Features of the whole
    table are made once. A row found on one side only counts as changed in every column;
    an empty table gives no rows."""
    found = cuts if not isinstance(cuts, int) else moments(df, order, cuts)
    with scratch() as keep:
        whole = stage(features(df).select(*dict.fromkeys([*keys, *order, *columns])))
        kinds = {c: whole.schema[c].dataType for c in columns}
        out = []
        for i, cut in enumerate(found):
            before = whole.where(_up_to(order, cut)).select(*keys, F.struct(*columns).alias("_a"))
            again = features(without_later(df, order, cut, outcomes)).select(*keys, F.struct(*columns).alias("_b"))
            lost = F.col("_a").isNull() | F.col("_b").isNull()
            both = before.join(again, list(keys), "full")
            counts = [F.count_if(lost | _differ(F.col("_a")[c], F.col("_b")[c], kinds[c], tolerance)).alias(c) for c in columns]
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_changed")) for c in columns])).alias("x")
            out.append(both.agg(F.count(F.lit(1)).alias("n_rows"), *counts).select(F.lit(i).alias("cut"), "n_rows", each).select("cut", "x.feature", "n_rows", "x.n_changed"))
        if not out:
            return df.sparkSession.createDataFrame([], "cut int, feature string, n_rows long, n_changed long")
        return keep(stage(reduce(DataFrame.unionAll, out)))
