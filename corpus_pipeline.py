"""A corpus pipeline of five stages over documents, each a DataFrame to a DataFrame.

1. quality: documents that the ordinal classifier rejects go.
2. lines: of equal and similar lines one stays.
3. near_duplicates: of documents whose five-word shingles are similar to 0.8 one stays.
4. decontaminate: documents contaminated by benchmark items go.
5. mix: sources are sampled to their target weights.

Stages return all columns of documents, whatever their names. n_chars follows the text
where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm import decontaminate as _decontaminate
from lagwise.llm import fuzzy_lines, mixing, ordinal, simhash
from lagwise.llm.common import free_name, stage, table

#: The columns that stages read; all others are kept from them under other names.
READ = ("doc_id", "text", "source", "n_chars")
#: Documents that go to a Python worker in one batch.
DOCUMENTS_AT_ONCE = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short_batches(spark: SparkSession) -> None:
    """Rows are whole documents, so few of them go to a Python worker at a time: batches are
    held by the executor and by the worker, several times each. For the rest of the session, as
    stages return DataFrames that run later; a lower setting stays."""
    most = int(spark.conf.get(_BATCH_SETTING))
    if not 0 < most <= DOCUMENTS_AT_ONCE:
        spark.conf.set(_BATCH_SETTING, DOCUMENTS_AT_ONCE)


def _apart(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *more: str) -> DataFrame:
    """step's rows with the columns of docs, and those named in more. step sees columns
    that it doesn't read under names that clash with none of its own."""
    _short_batches(docs.sparkSession)
    hidden = {c: c if c in READ else f"_kept{i}" for i, c in enumerate(docs.columns)}
    out = step(docs.toDF(*hidden.values()))
    return out.select(*[F.col(h).alias(c) for c, h in hidden.items()], *[F.col(c).alias(free_name(docs, c)) for c in more])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a grade of 1 (good) or more is at least one half."""
    _short_batches(spark)
    model = ordinal.fit(docs, ordinal.ratings(table(spark, sf_dir, "labels")))
    return _apart(docs, lambda d: ordinal.select(d, model).where("selected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their first occurrences of lines; one left without lines stays."""

    def step(d: DataFrame) -> DataFrame:
        out = fuzzy_lines.dedup_lines(d)
        return out.withColumn("n_chars", F.length("text").cast(d.schema["n_chars"].dataType)) if "n_chars" in d.columns else out

    return _apart(docs, step)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id in each group of near copies."""
    return _apart(docs, simhash.dedup)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words are in benchmark windows."""
    bench = table(spark, sf_dir, "benchmark")
    return _apart(docs, lambda d: _decontaminate.decontaminate(d, bench).where(~F.col("contaminated")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, with its number from 1 in the column copy
    (with underscores before it if documents have such a column)."""

    def step(d: DataFrame) -> DataFrame:
        out = mixing.mix(d).where("copies > 0")
        return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

    return _apart(docs, step, "copy")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Trained weights, MinHash and SimHash have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
