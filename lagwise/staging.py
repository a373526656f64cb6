"""Tables written to the folder that a cluster's machines share, and size-checked broadcasts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was staged and counted below this many rows.
BROADCAST_ROWS = 500_000
#: About so many rows go to one task of a table that is dealt by keys.
TASK_ROWS = 150_000
#: Up to so many parts (spark.shuffle.sort.bypassMergeThreshold) the shuffle's writer passes rows
#: on to their part's file; for more it gathers the whole of a task's input in memory and sorts it.
UNSORTED_PARTS = 200
#: Parts may have so many times the rows wanted before there are more than UNSORTED_PARTS.
FULLER = 10
#: The tables staged in the innermost scratch() of this thread; threads don't see each other's.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new path below the shared folder of spark.checkpoint.dir.

    Only where a local session names no such folder (as in tests) is one made on this
    machine, and set, so that later calls find it; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lagwise-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lagwise-{uuid.uuid4().hex}"


def stage(df: DataFrame, **options) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage,
    survives lost executors, and gives the planner the true size."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    made = _scope.get()
    if made is not None:
        made.append(out)
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table of which no later result is made."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """Tables staged inside, in this thread, are deleted at the end, but for those given to
    what this yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    before = _scope.set(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _scope.reset(before)
        for df in made:
            if not any(df is k for k in kept):
                unstage(df)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a staged table of narrow rows if it has at most so many rows;
    otherwise leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts_of(rows: int, of: int = TASK_ROWS) -> int:
    """How many parts so many rows are dealt into: of about `of` rows each, or of up to FULLER
    times as many where that keeps to UNSORTED_PARTS."""
    parts = max(1, math.ceil(rows / of))
    return parts if parts <= UNSORTED_PARTS else max(UNSORTED_PARTS, math.ceil(rows / (of * FULLER)))


def dealt(df: DataFrame, keys: Sequence[str], rows: int, of: int = TASK_ROWS) -> DataFrame:
    """df, which has about so many rows, dealt by keys into parts of about `of` rows: what a
    task sorts and sums doesn't grow with the table, however many rows a setting or a
    shuffle's compressed size would give it. See parts_of for very many rows."""
    return df.repartition(parts_of(rows, of), *keys)
