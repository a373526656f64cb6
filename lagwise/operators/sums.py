"""Sums over all rows of a numeric array that each batch of rows gives: what gradient and
histogram training need of a table. Tasks add up their own batches; one partial array a task
is shuffled, and the driver gets one array, whose size is by the model and never by the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length, without nulls, as rows by places."""
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def summed(df: DataFrame, size: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over the batches of df of what `of` gives, arrays of size numbers; zeros for
    an empty table."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(b)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["at", "sum"])

    out = np.zeros(size)
    for r in df.mapInArrow(own, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():
        out[r["at"]] = r["sum"]
    return out
