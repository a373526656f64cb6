"""Components of similar items that share buckets, without making all pairs of a bucket.

An item has an id, the number n of its shingles and marks, a bitmap of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, scratch, stage

SIMILAR = 0.8
#: Words of 64 bits in the bitmap of an item's shingles.
MARKS = 64
#: A bucket of more items is crowded: items meet PIVOTS more of its items before pairs.
CROWDED, PIVOTS = 32, 16


#: Hashes of the shingles of several texts (repeats allowed), and the place of each one's text.
Hashes = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: Up to so many values to look for are broadcast as they are; of more a bitmap is, SPARSE to 2 * SPARSE bits for each value, PAGE of them in a row.
LOOKED_FOR, SPARSE, PAGE = 1_000_000, 16, 1 << 15
#: Whether two items may be alike, by columns with two prefixes.
Near = Callable[[str, str], Column]
#: Items with their marks.
Mark = Callable[[DataFrame], DataFrame]
#: Rows and bytes of text that are worked on at a time in NumPy.
_ROWS_AT_ONCE, _BYTES_AT_ONCE = 2_048, 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly by multiplying and shifting."""
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; a plain sort is quicker here than numpy.unique."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def different(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The different pairs of a text's place and 48 bits of a hash, as one number."""
    return distinct((owner.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))


def bitmaps(keys: np.ndarray, texts: int) -> np.ndarray:
    """A row of MARKS words for each text, with a bit for each hash modulo their size."""
    bits = np.zeros((texts, MARKS * 64), np.uint8)
    bits[(keys >> np.uint64(48)).astype(np.int64), (keys % np.uint64(MARKS * 64)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def _pieces(batch: pa.RecordBatch, *texts: int) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Parts of batch with not too many rows and bytes, and their columns of texts; a part's texts
    are read from the batch when its turn comes."""
    lengths = [pc.binary_length(batch.column(k)).to_pylist() for k in texts]
    first, size = 0, 0
    for i, more in enumerate(map(sum, zip(*lengths, strict=True))):
        size += more
        if size >= _BYTES_AT_ONCE or i + 1 - first >= _ROWS_AT_ONCE or i + 1 == batch.num_rows:
            part = batch.slice(first, i + 1 - first)
            yield part, [part.column(k).to_pylist() for k in texts]
            first, size = i + 1, 0


def word_lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of longs as lists."""
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def similar(pairs: DataFrame, texts: DataFrame, hashes: Hashes, least: float = SIMILAR) -> DataFrame:
    """The pairs (u, v) of ids of texts (id, norm) whose sets of shingles have a Jaccard
    similarity of `least` or more. Texts meet, not sets, which are several times larger."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sides in _pieces(batch, 2, 3):
                a, b = (different(*hashes(x)) for x in sides)
                both = np.intersect1d(a, b, assume_unique=True)
                count = lambda keys: np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=part.num_rows)  # noqa: B023, E731
                k = count(both)
                yes = k >= least * (count(a) + count(b) - k) - 1e-9
                yield part.select([0, 1]).filter(pa.array(yes))

    met = pairs.select("u", "v")
    for i in "uv":
        met = met.join(texts.select(F.col("id").alias(i), F.col("norm").alias(f"{i}_norm")), i)
    return met.select("u", "v", "u_norm", "v_norm").mapInArrow(alike, "u long, v long")


def _near(a: str, b: str, least: float = SIMILAR) -> Column:
    """False only for pairs that can't be alike: each bit in which the marks differ
    stands for a shingle or more that only one of the two has."""
    # summed by a function over arrays: a sum of so many terms is too long to be compiled
    each = F.zip_with(f"{a}marks", f"{b}marks", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differing = F.aggregate(each, F.lit(0), lambda x, y: x + y)
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(n, m) >= F.greatest(n, m) * least - 1e-6) & (differing * (1 + least) <= (n + m) * (1 - least) + 1e-6)


def _hopeful(pairs: DataFrame, items: DataFrame, least: float = SIMILAR, near: Near | None = None, sift: bool = True) -> DataFrame:
    """The different pairs (u, v); if sift is set, without those that their marks rule out."""
    met = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    if not sift:
        return stage(met)
    for i in "uv":
        met = met.join(items.select(F.col("id").alias(i), F.col("marks").alias(f"{i}_marks"), F.col("n").alias(f"{i}_n")), i)
    return stage(met.where(near("u_", "v_") if near else _near("u_", "v_", least)).select("u", "v"))


def rooted(members: DataFrame, tied: DataFrame) -> DataFrame:
    """members plus the root of their id, which is the id itself if tied has none."""
    return members.join(broadcast_if_small(tied.withColumnRenamed("node", "id")), "id", "left").withColumn(
        "root", F.coalesce("root", "id"))


def _thinned(rows: DataFrame, column: str, wanted: DataFrame, values: int) -> DataFrame:
    """rows without most of those whose column (long) holds none of the `values` values of wanted: a bitmap is broadcast."""
    bits = 1 << max(15, (SPARSE * values - 1).bit_length())
    at = lambda d: F.pmod(F.xxhash64(d[column]), F.lit(bits))
    pages = wanted.select(at(wanted).alias("at")).select(F.floor(F.col("at") / PAGE).alias("_page"), F.pmod("at", F.lit(PAGE)).alias("at"))
    pages = stage(pages.repartition("_page").groupBy("_page").agg(F.bitmap_construct_agg("at").alias("_bits")))
    bit = F.pmod("_at", F.lit(PAGE)).cast("int")
    byte = F.ascii(F.decode(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    met = rows.withColumn("_at", at(rows)).withColumn("_page", F.floor(F.col("_at") / PAGE)).join(F.broadcast(pages), "_page")
    return met.where(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1).select(*rows.columns)


def among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows joined with the staged table wanted by column (long). Rows that meet none are mostly gone before any are shuffled."""
    values = wanted.count()
    if values <= LOOKED_FOR:
        return rows.join(F.broadcast(wanted), column)
    return _thinned(rows, column, wanted, values).join(wanted, column)


def _merged(tied: DataFrame, links: DataFrame) -> DataFrame:
    """tied with the components that links (u, v) join made one."""
    if not links.limit(1).count():
        return tied
    known = tied.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return stage(components(known.unionByName(links)))


def _buckets(members: DataFrame, tied: DataFrame) -> DataFrame:
    """key, id, root, size, main: members of the buckets that hold several components;
    main is the component with most of a bucket's items."""
    placed = rooted(members.select("key", "id"), tied)
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("key").agg(F.sum("n").alias("size"), F.max_by("root", F.struct("n", "root")).alias("main"),
                                       F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    return stage(placed.join(broadcast_if_small(stage(several)), "key"))


def _more_pivots(buckets: DataFrame) -> DataFrame:
    """u, v: items of crowded buckets with PIVOTS of the bucket's items that are in other
    components."""
    crowded = buckets.where(F.col("size") > CROWDED).select("key", "id", "root")
    turned = F.col("id").bitwiseXOR(F.col("key"))
    pivots = crowded.groupBy("key", F.pmod("id", F.lit(PIVOTS)).alias("_turn")).agg(F.min(turned).alias("lo")).select(
        "key", F.col("lo").bitwiseXOR(F.col("key")).alias("id"))
    pivots = stage(crowded.join(broadcast_if_small(stage(pivots)), ["key", "id"])).select(
        "key", F.col("id").alias("v"), F.col("root").alias("v_root"))
    return crowded.join(broadcast_if_small(pivots), "key").where("root <> v_root").select(F.col("id").alias("u"), "v")


def _open_pairs(buckets: DataFrame, items: DataFrame, near: Near = _near, mark: Mark | None = None) -> DataFrame:
    """u, v: items of one bucket and different components that may be alike. Items outside
    the bucket's main component meet all others; in crowded buckets marks are compared
    before a pair is made."""
    small, crowded = buckets.where(F.col("size") <= CROWDED), buckets.where(F.col("size") > CROWDED)
    few = small.join(small.where("root <> main").select("key", F.col("id").alias("v"), F.col("root").alias("v_root")), "key")
    own = crowded.groupBy("id").agg(F.collect_set("key").alias("keys")).join(items, "id")
    marked = stage(crowded.join((mark(own) if mark else own).select("id", "keys", "marks", "n"), "id"))
    stray = marked.where("root <> main").select("key", *[F.col(c).alias(f"s_{c}") for c in ("id", "root", "marks", "n", "keys")])
    # two items meet in the least of their buckets only, and two strays once
    once = ((F.col("root") == F.col("main")) | (F.col("id") < F.col("s_id"))) & (F.array_min(F.array_intersect("keys", "s_keys")) == F.col("key"))
    many = marked.join(stray, "key").where((F.col("root") != F.col("s_root")) & once & near("", "s_"))
    return _hopeful(few.where("root <> v_root").select(F.col("id").alias("u"), "v"), items, near=near, sift=not mark).unionByName(
        stage(many.select(F.least("id", "s_id").alias("u"), F.greatest("id", "s_id").alias("v"))))


def linked(bands: DataFrame, describe: Callable[[DataFrame], DataFrame], alike: Callable[[DataFrame, DataFrame], DataFrame],
           near: Near = _near, mark: Mark | None = None) -> DataFrame:
    """node, root: components of the items that are linked and share a bucket.

    bands: id, key (both long; repeats allowed). describe gives, for the ids of buckets
    with several items, what is compared: id, n, marks and whatever alike needs. alike
    keeps the pairs (u, v) that are links. near tells by the marks of two items, whose columns
    start with the two prefixes, whether they may be alike. mark adds marks to described
    items that have none, only for the strays of crowded buckets and what they meet; other pairs then go to alike at once.

    In each bucket all items meet one of them, the pivot, another in each bucket. In
    crowded buckets that this leaves with several components, items meet a few pivots
    more. Where there are still several, the items outside the largest then meet those
    of other components. No link that would join two components is lost, and a
    component's own items aren't compared with each other."""
    with scratch() as keep:
        # the exclusive or with the key puts the ids of each bucket in an order of its own
        turned = F.col("id").bitwiseXOR(F.col("key"))
        shared = bands.groupBy("key").agg(F.min(turned).alias("lo"), F.max(turned).alias("hi")).where("lo < hi")
        shared = stage(shared.select("key", F.col("lo").bitwiseXOR(F.col("key")).alias("pivot")))
        members = stage(among(bands, "key", shared).select("key", "id", "pivot").distinct())
        items = stage(describe(stage(members.select("id").distinct())))
        star = members.where("id <> pivot").select(F.col("pivot").alias("u"), F.col("id").alias("v"))
        tied = stage(components(alike(_hopeful(star, items, near=near, sift=not mark), items)))
        tied = _merged(tied, stage(alike(_hopeful(_more_pivots(_buckets(members, tied)), items, near=near, sift=not mark), items)))
        return keep(_merged(tied, stage(alike(_open_pairs(_buckets(members, tied), items, near, mark), items))))
