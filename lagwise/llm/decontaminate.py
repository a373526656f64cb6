"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
benchmark texts, run once over each text, with offsets mapped to the original.

A window is 13 consecutive words of an item. The automaton holds pieces of 7 words, one
after the other, so every window holds a whole piece; where a piece occurs, the run of
equal words around it is followed in both directions, and a run of 13 words or more
consists of windows. So the automaton grows with the benchmark's texts and not with
their windows, which repeat each word 13 times."""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stage

WINDOW = 13
#: Every worker holds an automaton; a benchmark of more bytes is dealt to several, and
#: the texts are scanned with one after the other.
PART_BYTES = 4 << 20
#: What a scan finds in a text: its number of words, ranges of hit words and of characters.
HITS = "n long, first array<int>, last array<int>, items array<string>, begin array<int>, end array<int>"

#: A-Z become a-z, other ASCII outside 0-9 and a-z a blank; bytes from 128 stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_loaded: dict = {}


def words(text: str | None) -> list[str]:
    folded = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    return [w.decode("utf-8", "surrogatepass") for w in folded.split()]


class Machine:
    """An automaton over the pieces of items (id or None, text). A piece leads to its
    length in words and the places where it stands in items."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW):
        import ahocorasick

        self.width = width
        self.items = [(i, w) for i, w in ((i, words(t)) for i, t in items) if w]
        places: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        half = (width + 1) // 2
        for k, (_, w) in enumerate(self.items):
            step = half if len(w) >= width else len(w)
            for at in range(0, len(w) - step + 1, step):
                places.setdefault(tuple(w[at : at + step]), []).append((k, at))
        self.pieces = ahocorasick.Automaton()
        for piece, found in places.items():
            self.pieces.add_word(f" {' '.join(piece)} ", (len(piece), found))
        if places:
            self.pieces.make_automaton()

    def scan(self, w: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [first, last] ranges of the words w that are hit, and the ids of the
        items whose windows occur, null ids left out."""
        if not w or not len(self.pieces):
            return [], set()
        starts: list[int] = []
        runs: list[tuple[int, int]] = []
        ids: set[str] = set()
        followed: dict[tuple[int, int], int] = {}
        for end, (length, places) in self.pieces.iter(f" {' '.join(w)} "):
            if not starts:
                at = 1
                for x in w:
                    starts.append(at)
                    at += len(x) + 1
            last = bisect.bisect_right(starts, end) - 1
            first = last - length + 1
            for k, at in places:
                name, item = self.items[k]
                if followed.get((k, first - at), -1) >= last:
                    continue
                a, b, shift = first, last, first - at
                while a > max(0, shift) and w[a - 1] == item[a - 1 - shift]:
                    a -= 1
                while b + 1 < min(len(w), len(item) + shift) and w[b + 1] == item[b + 1 - shift]:
                    b += 1
                followed[k, shift] = b
                if b - a + 1 >= min(self.width, len(item)):
                    runs.append((a, b))
                    if name is not None:
                        ids.add(name)
        return merged(runs), ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order; those that overlap or follow each other at once made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The [begin, end) offsets in the original text of ranges of its words."""
    spans, at, inside = [], 0, False
    for i, c in enumerate(text):
        ok = c.isascii() and c.isalnum() or ord(c) > 127
        if ok and not inside:
            at = i
        elif inside and not ok:
            spans.append((at, i))
        inside = ok
    if inside:
        spans.append((at, len(text)))
    return [(spans[a][0], spans[b][1]) for a, b in ranges]


def _parts(benchmark: DataFrame, id_col: str, text: str, most: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The different items, in parts of about most bytes or less, one part on the driver
    at a time. Items are whole: one item is the least that a part holds."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text).alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = 1 if size <= most else -(-2 * size // most)
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def _scanner(held, width: int):
    """A function of texts, and of what other parts of the benchmark hit in them, for the
    broadcast part held."""
    key = uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def found(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Machine(held.value, width)
        for columns in batches:
            rows = []
            for t, first, last, old in zip(*columns, strict=True):
                w = words(t)
                ranges, items = _loaded[key].scan(w)
                if first is not None and len(first):  # what other parts of the benchmark hit
                    ranges, items = merged([*ranges, *zip(map(int, first), map(int, last), strict=True)]), items | set(old)
                spans = char_spans(t, ranges) if ranges else []
                rows.append((len(w), *[[r[k] for r in ranges] for k in (0, 1)], sorted(items), *[[x[k] for x in spans] for k in (0, 1)]))
            yield pd.DataFrame(rows, columns=["n", "first", "last", "items", "begin", "end"])

    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", width: int = WINDOW, percent: int = 5, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs plus n_words, n_hit, n_items, items_sha256, contaminated, hit_spans.

    A document word within any occurrence of an item's window is hit. A document is
    contaminated if words are hit and they are percent or more of its words. hit_spans
    are the ranges of hit words as offsets [begin, end) in characters of the original text.
    Null and empty texts have no words and are clean; items without words have no window.
    Items with a null id hit words but aren't counted among the items; items of one id
    count as one. Rows are independent, so repeated rows and null ids pass through; columns
    named like the results are replaced.
    """
    plain, names = numbered(docs)
    whole = F.col(names[text])
    parts = _parts(benchmark, item_id, item_text, part_bytes)
    part, out = next(parts), plain
    before = [F.lit(None).cast(t) for t in ("array<int>", "array<int>", "array<string>")]
    while part is not None:
        found = _scanner(docs.sparkSession.sparkContext.broadcast(part), width)
        out = out.withColumn("hits", found(whole, *before))
        part, before = next(parts, None), [F.col("hits.first"), F.col("hits.last"), F.col("hits.items")]
        if part is not None:
            out = stage(out)
    n, spans = F.col("hits.n"), F.arrays_zip(F.col("hits.begin").alias("begin"), F.col("hits.end").alias("end"))
    n_hit = F.aggregate(F.zip_with("hits.first", "hits.last", lambda a, b: (b - a + 1).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    results = {"n_words": n, "n_hit": n_hit, "n_items": F.size("hits.items").cast("long"),
               "items_sha256": F.sha2(F.concat_ws(",", "hits.items"), 256),
               "contaminated": (n_hit > 0) & (100 * n_hit >= percent * n), "hit_spans": spans}
    return out.select(*[F.col(c).alias(o) for o, c in names.items() if o not in results], *[v.alias(k) for k, v in results.items()])


def spans_text(spans):
    """Spans as one string: begin-end, with semicolons between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ";")


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("hit_spans", spans_text("hit_spans")).drop("text")


def oracle() -> str:
    """DuckDB: the windows of the items meet the documents' word runs of equal length."""
    split = ("string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')")
    own = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    return f"""
WITH bw AS (SELECT item_id, list_filter({split}, lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT item_id, w, CASE WHEN len(w) < {WINDOW} THEN len(w) ELSE {WINDOW} END AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, list_filter({split}, lambda x: x <> '') AS w FROM documents),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT r.doc_id, r.i, r.n, win.item_id FROM runs r JOIN win ON r.n = win.n AND r.s = win.s),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM occ),
hit AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY 1),
raw AS (SELECT doc_id, regexp_extract_all(text, '{own}') AS o, string_split_regex(text, '{own}') AS sep FROM documents WHERE doc_id IN (SELECT doc_id FROM hit)),
long AS (SELECT doc_id, unnest(range(1, len(o) + 1)) AS k, unnest(list_transform(o, lambda x: length(x))) AS n,
                unnest(list_transform(sep[1:len(o)], lambda x: length(x))) AS s FROM raw),
ends AS (SELECT doc_id, k, n, sum(n + s) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM long),
isle AS (SELECT doc_id, min(e - n) AS b, max(e) AS e FROM
         (SELECT doc_id, e, n, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM ends JOIN words USING (doc_id, k)) GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg(CAST(b AS VARCHAR) || '-' || CAST(e AS VARCHAR), ';' ORDER BY b) AS sp FROM isle GROUP BY 1),
its AS (SELECT doc_id, count(x) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS h
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
       coalesce(sp, '') AS hit_spans
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN spans USING (doc_id)"""
