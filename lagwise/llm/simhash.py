"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming verification and
distributed components.

near_duplicates links 64-bit fingerprints at a few differing bits. A similarity of 0.8
of word shingles lets a seventh of such bits differ, too many to share blocks, so
near_texts deals a text's shingles to parts whose number grows with the text, and the
fingerprint of each part is a block: what differs between close texts leaves parts
untouched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, stage
from .linking import bitmaps, different, distinct, linked, mixed, rooted, similar

SEED = 42
WIDTH = 3
#: Fingerprints link at so many differing bits or fewer; the blocks are made for it.
DISTANCE = 2
#: Buckets of up to so many fingerprints are compared pair by pair.
SMALL_BUCKET = 32
#: Words in the shingles of near_texts.
TEXT_WIDTH = 5
#: A text has a block for each of so many parts at most: at a similarity of 0.8 a part is
#: untouched and not empty with a chance of 0.35 or more, 1 - 0.65**16 = 99.9 % for one.
PARTS = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASHES_AT_ONCE = 65_536


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits, each 1 if it is set in over half of the shingles' hashes; as a signed long."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for first in range(0, n, _HASHES_AT_ONCE):
        h = [digest(join(w[i : i + width]), SEED) for i in range(first, min(n, first + _HASHES_AT_ONCE))]
        bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs plus fp, the fingerprint as a long. Null and empty texts have 0."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t, width) for t in s], dtype="int64")

    return docs.withColumn("fp", fp(F.col(text)))


def links(fps: DataFrame, small: int = SMALL_BUCKET) -> DataFrame:
    """u, v: links whose components are those of all pairs of fps (column fp,
    distinct) that differ in at most two bits.

    Four blocks of 16 bits: two changed bits leave two blocks untouched, so close
    pairs share one of the six pairs of blocks. Fingerprints join on these; buckets
    of up to `small` are verified pair by pair. The members of larger buckets meet
    at points instead: each goes to itself and its 64 neighbours at one bit. Two of
    them meet if and only if they differ in at most two bits, at most 65 meet in a
    point, and one link each to the least ties them; so the work stays linear.
    """
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
                     for k, (i, j) in enumerate(pairs)])
    members = fps.select("fp", F.explode(keys).alias("key"))
    shared = stage(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    few = members.join(broadcast_if_small(shared.where(F.col("n") <= small).select("key")), "key")
    bucket = few.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    verified = (bucket.select("fps", F.posexplode("fps").alias("at", "u"))
                .select("u", F.explode(F.expr("slice(fps, at + 2, size(fps))")).alias("v"))
                .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE))
    crowded = members.join(broadcast_if_small(shared.where(F.col("n") > small).select("key")), "key").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    point = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = (point.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
           .select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v"))
    return verified.select("u", "v").unionByName(met).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable by links), one row per row of docs.

    Equal fingerprints are one node, so groups of copies cost one row each after
    the first count. Null and empty texts have fingerprint 0 and link like others.
    A null id gets its group's smallest id, null if it has none. Repeated rows each
    return; an empty table returns no rows.
    """
    marked = stage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    tied = components(links(fps.select("fp")))
    named = fps.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(norm: str, width: int = TEXT_WIDTH) -> np.ndarray:
    """The different hashes, in order, of the runs of width words of a text whose words
    stand apart by one blank; a shorter text is one run."""
    words = norm.encode("utf-8", "surrogatepass").split(b" ")
    n = len(words) - width + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    each = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mixed(h + each[k : k + n] + np.uint64(k + 1))
    return distinct(h)


def blocks(h: np.ndarray) -> list[int]:
    """The keys of the blocks of a text with the shingles h, as signed longs.

    A text of 2**k to 2**(k+1) shingles has 2**k / 2 + 1 parts, and one of up to a quarter
    over 2**k also those of the class below. So two texts of a similarity of 0.8 have a
    class in common in which fewer shingles differ than there are parts."""
    k = len(h).bit_length() - 1
    out = []
    for level in [k, k - 1] if k and 4 * len(h) <= 5 << k else [k]:
        parts = (1 << level) // 2 + 1
        at = (h >> np.uint64(16)) % np.uint64(parts)
        for j in range(min(parts, PARTS)):
            own = h[at == np.uint64(j)]
            if len(own):
                bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                block = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own)).view(">u8").astype(np.uint64)
                out.append(mixed(block + np.uint64(level << 8 | j)).view(np.int64)[0])
    return out


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = TEXT_WIDTH) -> DataFrame:
    """doc_id, component_id (smallest id reachable by links), one row per row of docs.

    Texts, without case and with blanks alike, are linked if they share a block, the
    Hamming distance of their bitmaps allows it, and the Jaccard similarity of their
    shingles of width words is SIMILAR or more. Null, empty and blank texts are equal; texts
    of fewer words are one shingle. A null id gets its group's smallest id, null if it has
    none. Repeated rows each return; an empty table returns no rows."""

    @F.pandas_udf("keys array<long>, n int, marks array<long>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [(blocks(h), len(h), bitmaps(different(h, np.zeros(len(h))), 1)[0]) for h in (shingle_hashes(t, width) for t in s)]
            yield pd.DataFrame(rows, columns=["keys", "n", "marks"])

    def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [shingle_hashes(t, width) for t in texts]
        return np.concatenate(each), np.repeat(np.arange(len(each)), [len(h) for h in each])

    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    rows = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm")).withColumn("id", F.xxhash64("norm"))
    marked = stage(rows.select("doc_id", "id", described("norm").alias("d")).select("doc_id", "id", "d.*"))

    def describe(wanted: DataFrame) -> DataFrame:
        return marked.select("id", "n", "marks").join(broadcast_if_small(wanted), "id").dropDuplicates(["id"])

    def alike(pairs: DataFrame, items: DataFrame) -> DataFrame:
        ids = stage(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
        texts = stage(rows.select("id", "norm").join(broadcast_if_small(ids), "id").distinct())
        return similar(pairs, texts, hashes)

    tied = linked(marked.select("id", F.explode("keys").alias("key")), describe, alike)
    placed = stage(rooted(marked.select("doc_id", "id"), tied))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root").select("doc_id", "component_id")


def dedup(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """docs without those that a document of a smaller id is near, by groups (doc_id,
    component_id), near_texts of docs if None. Rows of one doc_id are one document: they
    stay or go together; null ids stay."""
    groups = near_texts(docs) if groups is None else groups
    gone = stage(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)


def query(spark, sf_dir):
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
