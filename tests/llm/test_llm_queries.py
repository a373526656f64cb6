"""The registered queries against their SQL, and the pipeline stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lagwise.llm import decontaminate, fuzzy_lines, mixing, ordinal, queries
from lagwise.llm.common import table

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "benchmark", "labels", "conversations", "embeddings"]


def components_of(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    found = db.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    b = sorted(repr([plain(r[found.columns.index(c)]) for c in order]) for r in found.fetchall())
    assert a == b


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op2_ordinal_quality", "op4_fuzzy_lines", "op5_string_kernel_toxicity", "op6_media_columns", "op8_simhash", "op10_token_counts", "op11_token_alignment", "op13_ngram_join"])
def test_every_document_returns(spark, name):
    got = queries.queries()[name](spark, SF)
    docs = table(spark, SF, "documents")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline_stages(spark):
    start = table(spark, SF, "documents").withColumn("extra", F.lit("kept"))
    docs = start.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "mix"]
    for name, step in corpus_pipeline.STAGES:
        before = spark.createDataFrame(docs, start.schema)
        out = step(spark, before, SF)
        rows = out.collect()
        old = {r.doc_id: r for r in docs}
        if name == "quality":
            model = ordinal.fit(before, ordinal.ratings(table(spark, SF, "labels")))
            kept = {r.doc_id for r in ordinal.select(before, model).where("tail >= 0.5").collect()}
            assert {r.doc_id for r in rows} == kept and 0 < len(kept) < len(docs)
        if name == "lines":
            assert {r.doc_id for r in rows} == set(old) and all(r.n_chars == len(r.text) for r in rows)
            assert sum(len(r.text) for r in rows) < sum(len(r.text) for r in docs)
            again = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, start.schema)).agg(F.sum("n_removed")).first()[0]
            assert again <= 2
        if name == "near_duplicates":
            split = {r.doc_id: (r.text or "").lower().split() for r in docs}
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in split.items()}
            ids = sorted(sets)
            near = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]])]
            want = {ids[k] for k, r in enumerate(components_of(len(ids), near)) if k == r}
            assert want <= {r.doc_id for r in rows} and len(rows) <= len(want) + 1
        if name == "decontaminate":
            bench = table(spark, SF, "benchmark")
            windows = {tuple(w[k : k + 13]) for w in (decontaminate.words(r.text) for r in bench.collect()) for k in range(max(1, len(w) - 12)) if w}
            lengths = {len(w) for w in windows}
            clean = set()
            for r in docs:
                w = decontaminate.words(r.text)
                hit = {j for n in lengths for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
                if not (hit and 20 * len(hit) >= len(w)):
                    clean.add(r.doc_id)
            assert {r.doc_id for r in rows} == clean
        if name == "mix":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert got == {i: n for i, n in copies.items() if n} and out.columns == [*start.columns, "copy"]
            break
        assert out.columns == start.columns and all(r.extra == "kept" for r in rows)
        if name != "lines":
            assert all(r == old[r.doc_id] for r in rows)
        docs = rows
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        assert out.count() == 0


RESULTS = ["expected_grade", "tail", "tails", "selected", "scored", "n_lines", "n_removed", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
           "hit_spans", "hits", "size", "source_size", "target", "copies", "taken", "copy", "row", "lines", "norm", "id", "key", "root", "component_id", "c0", "_kept0"]


def test_pipeline_keeps_clashing_columns(spark):
    """Columns of documents that are named like what the operators add come back unchanged."""
    docs = table(spark, SF, "documents").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in RESULTS})
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        assert out.columns == [*docs.columns, *["_copy"] * (name == "mix")]
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in RESULTS)


def test_pipeline_odd_rows(spark):
    """Nulls in any column, repeated rows and texts without words."""
    docs = table(spark, SF, "documents").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, None, "en", None, 0), (-1, None, "en", None, 0), (-2, "", None, "s", None), (-3, " ", "de", "s", 1)], docs.schema)
    out = docs.unionByName(odd).unionByName(odd)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, out.select(docs.columns), SF)
        assert out.count() > 0
