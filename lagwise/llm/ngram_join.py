"""N-gram Jaccard join: the components of documents whose sets of word n-grams have a
Jaccard similarity of LEAST per cent or more, without loss.

All n-grams are put in one order, those of low counts first. Of a pair that is similar
enough, each one's first n - ceil(LEAST * n / 100) + 1 n-grams, its prefix, hold one of the
other's (prefix filter). So documents meet on the n-grams of their prefixes. A pair goes on
only if its sizes (length filter), the n-grams before and after the shared one (positional
filter) and the bits in which the bitmaps of what follows differ (suffix filter, here by
bitmaps in place of halves) leave the similarity possible; pairs that go on are made
distinct and verified once, by exact sets.

A group of near copies would make as many pairs as the square of its size. So in each
bucket of documents that share a prefix n-gram all meet one first: that with the fewest
rarer n-grams, which is the least edited copy. Components then tell what is tied already,
and only documents outside a bucket's main component meet those of other components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, scratch, stage, unstage
from .linking import _buckets, _hopeful, _merged, _near, bitmaps, different, distinct, mixed, rooted, word_lists

WIDTH = 4
#: Per cent of the union that the intersection has at least.
LEAST = 85
#: N-grams are counted in so many cells; one that shares its cell looks as frequent as both.
CELLS = 1 << 18
#: Buckets of more documents are crowded: bitmaps are compared before a pair is made.
CROWDED = 32
_SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CELLS_AT_ONCE = 1 << 16


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different hashes, in order, of the runs of width words of a text; one of all
    its words if there are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.array([xxhash.xxh64_intdigest(w, _SEED) for w in words], np.uint64)
    n = max(1, len(words) - width + 1)
    h = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(len(words), width)):
        h = mixed(h + each[k : k + n] + np.uint64(k + 1))
    return distinct(h)


def _id_of(h: np.ndarray) -> int:
    """A set's 64 bits: the sum of its hashes and their number, mixed; as a signed long."""
    return int(mixed(np.array([h.sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def measured(docs: DataFrame, width: int = WIDTH, cells: int = CELLS) -> tuple[DataFrame, np.ndarray]:
    """doc_id, of_text, id, n of docs (doc_id, text, of_text): the set's id and its size; and
    the counts of all n-grams by cell, summed in Spark: as many numbers at any size of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)

        names = ["doc_id", "of_text", "id", "n", "cell", "count"]
        longs = pa.list_(pa.int64())
        for batch in batches:
            ids, sizes = [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), width)
                ids.append(_id_of(h))
                sizes.append(len(h))
                np.add.at(total, (h % np.uint64(cells)).astype(np.int64), 1)
            none = pa.nulls(len(ids), longs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), none, none], names)
        used = np.flatnonzero(total)
        for i in range(0, len(used), _CELLS_AT_ONCE):
            part = used[i : i + _CELLS_AT_ONCE]
            own = [pa.nulls(1, batch.column(0).type), *[pa.array([x], pa.int64()) for x in (0, 0, -1)], *[pa.array([x], longs) for x in (part, total[part])]]
            yield pa.RecordBatch.from_arrays(own, names)

    found = stage(docs.mapInArrow(measure, f"doc_id {kind}, of_text long, id long, n long, cell array<long>, count array<long>"))
    sums = found.where("n < 0").select(F.explode(F.arrays_zip("cell", "count")).alias("c")).groupBy("c.cell").agg(F.sum("c.count").alias("count"))
    counts = np.zeros(cells, np.int64)
    table = sums.toArrow()
    counts[table["cell"].to_numpy()] = table["count"].to_numpy()
    return found.where("n >= 0").select("doc_id", "of_text", "id", "n"), counts


def prefixes(texts: DataFrame, counts: np.ndarray, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """id, n, keys of each row of texts (text) with words; keys are the n-grams of its prefix, in order."""
    shared = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, 0x7FFFFFFF).astype(np.int32))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            ids, sizes, keys = [], [], []
            for t in batch.column(0):
                h = shingles(t.as_py(), width)
                n = len(h)
                if not n:
                    continue
                ids.append(_id_of(h))
                sizes.append(n)
                first = n - (least * n + 99) // 100 + 1
                keys.append(h[np.lexsort((h, order[(h % np.uint64(len(order))).astype(np.int64)]))[:first]].view(np.int64))
            if ids:
                ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                                                  pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))], ["id", "n", "keys"])

    return texts.mapInArrow(cut, "id long, n long, keys array<long>")


def marked(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, n and marks, the bitmap of the set, of texts (id, norm)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1_024):
                part = batch.slice(first, 1_024)
                sets = [shingles(t.as_py(), width) for t in part.column(1)]
                marks = np.stack([bitmaps(different(h, np.zeros(len(h))), 1)[0] for h in sets])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in sets], pa.int64()), word_lists(marks)], ["id", "n", "marks"])

    return texts.select("id", "norm").mapInArrow(mark, "id long, n long, marks array<long>")


def _verified(met: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs (u, v, u_norm, v_norm) whose sets are similar enough."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0))
        for batch in batches:
            yes = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if u != last[0]:  # the pairs of one u mostly come together
                    last = (u, shingles(a.as_py(), width))
                x, y = last[1], shingles(b.as_py(), width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(100 * both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return met.mapInArrow(keep, "u long, v long")


def _fits(least: int, n: Column, at: Column, m: Column, by: Column) -> Column:
    """The length and the positional filter of two sets of n and m n-grams that share one
    at places at and by: what precedes it in both, it, and what follows it in both is all
    that they can have in common."""
    most = F.least(at, by) + 1 + F.least(n - at, m - by) - 1
    return (100 * F.least(n, m) >= least * F.greatest(n, m)) & (most * (100 + least) >= least * (n + m))


def linked(found: DataFrame, texts_of, alike, least: int = LEAST) -> DataFrame:
    """node, root: the components of the sets of prefixes() (id, n, keys; no id twice).
    texts_of gives id and norm, a text of each set of some ids; alike keeps the pairs
    (u, v) that are links."""
    at_least = least / 100
    with scratch() as keep:
        bands = found.select("id", "n", F.posexplode("keys").alias("at", "key"))
        # most keys are of one set: counting them alone moves least
        shared = stage(bands.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("key"))
        shared = stage(bands.join(broadcast_if_small(shared, 2_000_000), "key"))
        lead = shared.groupBy("key").agg(F.min(F.struct("at", "n", "id")).alias("p"))
        members = stage(shared.join(lead, "key").select("id", "n", "at", "key", F.col("p.id").alias("p_id"), F.col("p.n").alias("p_n"), F.col("p.at").alias("p_at")))
        unstage(shared)
        items = stage(marked(texts_of(members.select("id"))).dropDuplicates(["id"]))
        fits = _fits(least, F.col("n"), F.col("at"), F.col("p_n"), F.col("p_at"))
        star = members.where((F.col("id") != F.col("p_id")) & fits).select(F.col("p_id").alias("u"), F.col("id").alias("v"))
        tied = stage(components(alike(_hopeful(star, items, at_least))))
        # what is left: members of buckets of several components, outside the largest of them
        buckets = _buckets(members, tied)
        placed = stage(buckets.join(members.select("key", "id", "n", "at"), ["key", "id"]))
        stray = placed.where("root <> main").select("key", *[F.col(c).alias(f"s_{c}") for c in ("id", "root", "n", "at")])
        apart = (F.col("root") != F.col("s_root")) & _fits(least, F.col("n"), F.col("at"), F.col("s_n"), F.col("s_at"))
        few = placed.where(F.col("size") <= CROWDED).join(stray, "key").where(apart).select(F.col("id").alias("u"), F.col("s_id").alias("v"))
        crowded = stage(placed.where(F.col("size") > CROWDED).join(items.select("id", "marks"), "id"))
        stray = crowded.where("root <> main").select("key", *[F.col(c).alias(f"s_{c}") for c in ("id", "root", "n", "at", "marks")])
        many = crowded.join(stray, "key").where(apart & _near("", "s_", at_least))
        many = stage(many.select(F.least("id", "s_id").alias("u"), F.greatest("id", "s_id").alias("v")).distinct())
        return keep(_merged(tied, stage(alike(_hopeful(few, items, at_least).unionByName(many).distinct()))))


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = LEAST, cells: int = CELLS) -> DataFrame:
    """doc_id, n_shingles (size of the set of n-grams of width words), component_id (the
    smallest doc_id reachable by links, its own included), one row for each row of docs.

    Two documents are linked when 100 * intersection >= least * union. Equal sets are one
    node, known by 64 bits. A text of fewer words is one n-gram; a null, empty or blank
    text has none and is linked with nothing, so its component is its own id. A null id
    gets its component's smallest id, null if there is none. Repeated rows each return;
    an empty table returns no rows."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("of_text"))
    rows, counts = measured(plain, width, cells)
    found = stage(prefixes(plain.select("text"), counts, width, least).dropDuplicates(["id"]))

    # a row of each set, told by its id and text; rows that repeat both give the same text again
    firsts = stage(rows.where("n > 0").groupBy("id").agg(F.min(F.struct("of_text", "doc_id")).alias("at")))

    def texts_of(ids: DataFrame) -> DataFrame:
        """The columns of ids (id, any others) and norm. Texts are read where they lie: what
        moves is ids."""
        wanted = firsts.join(broadcast_if_small(stage(ids.select("id").distinct())), "id", "left_semi")
        met = stage(ids.distinct().join(broadcast_if_small(stage(wanted)), "id"))
        same = (F.col("of_text").eqNullSafe(F.col("at.of_text"))) & F.col("doc_id").eqNullSafe(F.col("at.doc_id"))
        return plain.join(broadcast_if_small(met), same).select(*ids.columns, F.col("text").alias("norm"))

    def alike(pairs: DataFrame) -> DataFrame:
        ones = texts_of(pairs.select(F.col("u").alias("id"))).dropDuplicates(["id"]).select(F.col("id").alias("u"), F.col("norm").alias("u_norm"))
        others = texts_of(pairs.select(F.col("v").alias("id"), "u")).select("u", F.col("id").alias("v"), F.col("norm").alias("v_norm"))
        return _verified(others.join(ones, "u").select("u", "v", "u_norm", "v_norm"), width, least).distinct()

    tied = linked(found, texts_of, alike, least)
    placed = stage(rooted(rows, tied))
    smallest = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    # texts without words have one id and stay apart
    return placed.join(smallest, "root", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def query(spark, sf_dir):
    from .common import table

    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))
