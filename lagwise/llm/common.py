"""Helpers shared by the training-data operators: tables, free column names, connected
components. Staged tables and size-checked broadcasts are the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.staging import BROADCAST_ROWS, broadcast_if_small, scratch, shared_dir, stage, unstage

__all__ = ["BROADCAST_ROWS", "broadcast_if_small", "components", "free_name", "numbered", "scratch", "shared_dir", "stage", "table", "unstage"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., which clash with nothing, and the new name
    of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns u, v (any orderable type), in any direction, repeats allowed;
    rows with a null end are ignored. Returns node, root (the smallest node of
    the component), one row for each node that has an edge to another node.
    Each node's minimum is a partial aggregation and edges then meet it in an
    equi-join, so a node with very many edges is never gathered in one task.
    """
    a, b = F.col("u"), F.col("v")
    cur = stage(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u > v").distinct())
    # edges have at most twice as many nodes, which bounds the tables of minima
    hint = F.broadcast if 2 * cur.count() <= BROADCAST_ROWS else lambda df: df
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node points to the node's minimum
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(hint(least), "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        # small star: every smaller neighbour, and the node, point to the minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(hint(low), "u")
        small = (met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, cur = cur, stage(small)
        unstage(before)
        now = cur.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")),
                      F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
