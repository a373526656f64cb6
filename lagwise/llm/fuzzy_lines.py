"""Line dedup: keys of a line's content, exact Jaccard over character shingles and
distributed components, all in DataFrame operations.

A shingle is a line's 8 characters from any place on. Characters stand four bytes apart in
UTF-32, so a window of them is cut at the same cost wherever it is. Only lines that share a
key with another are hashed shingle by shingle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, numbered, stage
from .linking import among, linked, rooted

#: Characters in a shingle; a shorter line is one shingle.
SHINGLE = 8
#: The hashes of a line lie on a circle of 2 ** SLOT_BITS slots. A key is made of the first hashes from the start of
#: a slot on, so that lines of similarity s share one with chance s ** (hashes in it).
SLOT_BITS = 3
#: Pairs of neighbouring words in a key of lines that have many of them, and shingles in one of other lines.
OF_WORDS, OF_SHINGLES = 3, 4
#: Lines of MANY different pairs of words or more have keys of these; lines of fewer than SOME, or of
#: LONG characters a pair or more, have keys of shingles, so that of two similar lines both have the same kind.
MANY, SOME, LONG = 16, 24, 12
#: Lines of so many hashes or fewer have a key from each of them on.
FEW = 16
#: Of the least hashes of a line's shingles so many, 16 bits of each, are compared before its text is.
SKETCH = 1024
#: So many lines to go, of twelve bytes each, are broadcast; more are shuffled.
GONE = 2_000_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often, and in whatever lambda, use names it."""
    return F.transform(F.array(value), use)[0]


def _units(line: Column) -> Column:
    """The characters as four bytes each, one shingle's at least."""
    return F.encode(F.when(F.length(line) < SHINGLE, F.rpad(line, SHINGLE, "\0")).otherwise(line), "UTF-32")


def _size(units: Column) -> Column:
    return (F.octet_length(units) / 4).cast("int")


def _shingles(line: Column) -> Column:
    """The hashes of a line's shingles, one of each place."""
    each = lambda u: F.transform(F.sequence(F.lit(0), _size(u) - SHINGLE), lambda i: F.xxhash64(F.substring(u, i * 4 + 1, F.lit(4 * SHINGLE))))
    return _let(_units(line), each)


def _all_hashes(line: Column) -> Column:
    """The different hashes of all shingles, in order."""
    return F.sort_array(F.array_distinct(_shingles(line)))


def _word_pairs(line: Column) -> Column:
    """The different hashes of two neighbouring words each, in order."""
    pairs = _let(F.split(line, " "), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
    return F.sort_array(F.array_distinct(pairs))


def _runs(hashes: Column, width: int) -> Column:
    """The keys of a line: `width` hashes in turn, from the first of each slot on, round the end to the least."""
    slot = lambda h, i: F.shiftright(F.get(h, i), 64 - SLOT_BITS)

    def keys(h: Column) -> Column:
        n = F.size(h)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (n <= FEW) | (i == 0) | (slot(h, i) != slot(h, i - 1)))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(width), *[F.get(h, (i + k) % n) for k in range(width)]))

    return _let(hashes, keys)


def _keys(line: Column, pairs: Column) -> Column:
    """A line's keys."""
    none = F.array().cast("array<long>")
    n = F.size(pairs)
    return F.concat(F.when(n >= MANY, _runs(pairs, OF_WORDS)).otherwise(none),
                    F.when((n < SOME) | (F.length(line) >= LONG * n), _runs(_all_hashes(line), OF_SHINGLES)).otherwise(none))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), F.lower(text).alias("text"))


def signed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row (of id and whole text), doc_id, line_no, id, more, keys: every line that isn't
    blank. Lines are taken without case and without blanks at their ends; id and more
    are two hashes of that, keys what similar lines have in common."""
    lines = _rows(docs, doc_id, text).select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    norm = lines.select("row", "doc_id", "line_no", F.trim("line").alias("norm")).where("norm <> ''")
    pairs = norm.withColumn("pairs", _word_pairs(F.col("norm")))
    return pairs.select("row", "doc_id", "line_no", F.xxhash64("norm").alias("id"), F.xxhash64(F.lit(7), "norm").alias("more"),
                         _keys(F.col("norm"), F.col("pairs")).alias("keys"))


def described(texts: DataFrame) -> DataFrame:
    """texts (id, norm) plus n, the number of different shingles."""
    return texts.select("id", "norm", F.size(F.array_distinct(_shingles(F.col("norm")))).alias("n"))


def _marked(items: DataFrame) -> DataFrame:
    """items plus marks, the different last 16 bits of their least hashes."""
    least = F.slice(_all_hashes(F.col("norm")), 1, SKETCH)
    return items.withColumn("marks", F.array_distinct(F.transform(least, lambda h: F.shiftright(F.shiftleft(h, 48), 48).cast("short"))))


def _may_link(a: str, b: str) -> Column:
    """False for pairs that can't be alike. Each mark that only one of two lines has stands for a shingle or more that only this
    one has; at a similarity of 0.8 these are a ninth of both sizes at most. Of larger sets only the least hashes are known: one
    of the larger set's is also the other's with the chance p, and five standard deviations less are asked for (and what
    coincides within the marks)."""
    n, m, x, y = F.col(f"{a}n"), F.col(f"{b}n"), F.size(f"{a}marks"), F.size(f"{b}marks")
    both = F.size(F.array_intersect(f"{a}marks", f"{b}marks"))
    p = (n + m) * 4.0 / (F.greatest(n, m) * 9)
    few = SKETCH * p - 5 * F.sqrt(SKETCH * p * (1 - p)) - SKETCH + F.when(n >= m, x).otherwise(y)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & F.when(F.greatest(n, m) <= SKETCH, 9 * (x + y - 2 * both) <= n + m).otherwise(both >= few)


def alike_lines(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (u, v) of ids of items (id, norm, n) whose sets of shingles have a Jaccard similarity
    of 0.8 or more: those that have four ninths of both sizes or more in common."""
    met = pairs.select("u", "v")
    for i in "uv":
        met = met.join(items.select(F.col("id").alias(i), F.col("norm").alias(f"{i}_norm"), F.col("n").alias(f"{i}_n")), i)
    both = F.size(F.array_intersect(_shingles(F.col("u_norm")), _shingles(F.col("v_norm"))))
    return met.where(9 * both >= 4 * (F.col("u_n") + F.col("v_n"))).select("u", "v")


def similar_lines(texts: DataFrame, signed: DataFrame) -> DataFrame:
    """node, root: components of the lines that are linked by a similarity of 0.8 or more
    and share a key. signed has ids and keys; texts (id, norm) may repeat rows. Links are
    looked for as linking.linked does."""

    def describe(wanted: DataFrame) -> DataFrame:
        return described(among(texts, "id", wanted).select("id", "norm").distinct())

    return linked(signed.select("id", F.explode("keys").alias("key")), describe, alike_lines, _may_link, _marked)


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, line_no of the lines that go: all but the first of each component, in order
    of doc_id and place. Lines that are equal (but for case and blanks at their ends)
    are one node; a line goes as a copy only if both its hashes are the first line's."""
    signed = stage(signed_lines(docs, doc_id, text))
    lines = _rows(docs, doc_id, text).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    texts = lines.select(F.trim("line").alias("norm")).where("norm <> ''").withColumn("id", F.xxhash64("norm"))
    placed = rooted(signed.drop("keys"), similar_lines(texts, signed))
    firsts = placed.groupBy("root").agg(F.min(F.struct("doc_id", "row", "line_no", "id", "more")).alias("first"),
                                        F.count(F.lit(1)).alias("n"))
    again = stage(firsts.where("n > 1").select("root", "first"))
    same = F.col("row").eqNullSafe(F.col("first.row")) & F.col("line_no").eqNullSafe(F.col("first.line_no"))
    copy = (F.col("id") != F.col("first.id")) | (F.col("more") == F.col("first.more"))
    return stage(placed.join(broadcast_if_small(again), "root").where(~same & copy).select("row", "line_no"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text reduced to the lines that stay, and n_lines and n_removed.

    Of each component of equal or similar lines only the first stays. Blank lines stay
    and count in n_lines. A document all of whose lines go stays, without them. A null
    text stays null, with 0 lines; a null id comes before all others. Lines end at line
    feeds; a carriage return before one belongs to its line. Rows that repeat
    both id and text count as one document and keep the same lines. Columns named like
    the results are replaced. The lines to go are gathered per document only."""
    lines = removed_lines(docs, doc_id, text)
    gone = lines.groupBy("row").agg(F.collect_set("line_no").alias("gone"))
    if lines.limit(GONE + 1).count() <= GONE:  # bounds the lists too
        gone = F.broadcast(gone)
    plain, names = numbered(docs)
    whole = F.col(names[text])
    out = plain.withColumn("row", F.xxhash64(names[doc_id], names[text])).join(gone, "row", "left").withColumn("lines", F.split(whole, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    results = {text: F.when(F.col("gone").isNull(), whole).otherwise(cut),
               "n_lines": F.when(whole.isNull(), 0).otherwise(F.size("lines")).cast("long"),
               "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    kept = [results[text].alias(text) if c == text else F.col(n).alias(c) for c, n in names.items() if c not in ("n_lines", "n_removed")]
    return out.select(*kept, *[results[n].alias(n) for n in ("n_lines", "n_removed")])


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
