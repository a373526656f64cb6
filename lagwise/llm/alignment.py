"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The byte ends of both token lists are keys of two dictionaries; the keys that both have,
in order, cut the lists into groups, and each group's tokens are linked with each other.
Texts are tokenized in units, each a run of white space and what follows up to the next
one: the byte-level splitter always cuts there, and no piece of the other vocabulary spans
such a place. A unit is tokenized once in an Arrow batch and remembered; where the
vocabularies don't allow this, the whole text is the unit."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, stage

#: A pair of ids is a * BASE + b.
BASE = 1 << 22
#: Units remembered by one Python worker, up to this length.
REMEMBER, REMEMBER_CHARS = 400_000, 48
#: Groups of more links are counted by their different ids.
LARGE = 4_096
_CHARACTERS_AT_ONCE = 1_000_000
_UNIT = re.compile(r"(?<=\S)(?= )")
#: Letters of which no version of Unicode differs in what the splitter asks for.
_SETTLED = re.compile("[\n\r\t -~\u00a1-\u024f\u2013-\u2026]*")
#: The splitter of byte-level vocabularies; a fixed value.
_SPLITTER = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others for those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte = _byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(pieces)) > BASE:
            raise ValueError(f"vocabularies of more than {BASE} ids can't be paired")
        self.a_sizes, self.b_sizes = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_said, self.b_said = ([np.array([f"{i}{end}" for i in range(len(x))], object) for end in ends] for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        with open(a_path, encoding="utf-8") as f:
            made = json.load(f)
        splitter = made.get("pre_tokenizer") or {}
        by_words = (splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not made.get("normalizer"))
        self.by_units = by_words and not any(re.search("[^▁]▁", p) for p in pieces)
        self.quick = self._quick(made["model"], {t["id"] for t in made.get("added_tokens", [])}) if by_words else None
        self.known: dict = {}

    def _quick(self, model: dict, added: set[int]):
        """An encoder of the same vocabulary that takes a third of the time. It joins by
        ids, so it is used only where merges come in the order of the ids they make."""
        import tiktoken

        vocabulary = model["vocab"]
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ranks = {self.a_bytes[i]: i for i in vocabulary.values() if i not in added}
        if merged != sorted(merged) or len(ranks) != 256 + len(merged):
            return None
        return tiktoken.Encoding("a", pat_str=_SPLITTER, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, units: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        out = [self.quick.encode_ordinary(u) if _SETTLED.fullmatch(u) else None for u in units]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.a.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encoded(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of units, each of which begins with the blank that b puts in itself; none
        for one whose tokens' bytes aren't its own."""
        out = []
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for u, a, b in zip(units, self.a_ids(units), self.b.encode([u[1:] for u in units], num_threads=1), strict=True):
            same = b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == u.encode()
            out.append((np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if same else None)
        return out

    def units(self, text: str) -> list[str]:
        if not text or not self.by_units:
            return [" " + text] if text else []
        out = _UNIT.split(" " + text)
        if len(out) > 1 and out[-1].isspace():
            out[-2:] = [out[-2] + out[-1]]
        return out

    def ids(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of both tokenizers for each text, none where bytes differ."""
        cut = [self.units(t) for t in texts]
        known = self.known
        new = [u for u in {u for units in cut for u in units} if u not in known]
        if len(known) + len(new) > REMEMBER:
            kept = {u: known[u] for units in cut for u in units if u in known}
            known.clear()
            known.update(kept)
        for i in range(0, len(new), 10_000):
            known.update(zip(new[i : i + 10_000], self.encoded(new[i : i + 10_000]), strict=True))
        for units in cut:
            found = [known[u] for u in units]
            if None in found:
                found = []
            yield tuple(np.frombuffer(b"".join([f[k] for f in found]), np.int32) for k in (0, 1))
        for u in new:
            if len(u) > REMEMBER_CHARS:
                del known[u]


def common_ends(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a and of b end up to each byte at which both have an end, in order."""
    a_at, b_at = (dict(zip(np.cumsum(sizes).tolist(), range(1, len(sizes) + 1), strict=True)) for sizes in (a_sizes, b_sizes))
    ends = sorted(a_at.keys() & b_at.keys())
    return tuple(np.fromiter(map(at.__getitem__, ends), np.int64, len(ends)) for at in (a_at, b_at))


def _spelled(a, b, i, j, p, q, tools: Tokenizers) -> str:
    """The groups that take p and q tokens from places i and j on as text."""
    parts = np.empty(len(a) + len(b), object)
    for ids, own, other, said in ((a, p, j, tools.a_said), (b, q, i + p, tools.b_said)):
        place = np.arange(len(ids)) + np.repeat(other, own)
        parts[place] = said[0][ids]
        last = np.cumsum(own) - 1
        parts[place[last]] = said[1][ids[last]]
    return "".join(parts.tolist())[:-1]


def _pairs(a, b, i, j, p, q) -> tuple[np.ndarray, np.ndarray]:
    """The different linked pairs of those groups, and how often each is linked."""
    links = p * q
    large = links > LARGE
    keys, times = [], []
    for g in np.flatnonzero(large):
        (x, n), (y, m) = (np.unique(ids[at : at + k], return_counts=True) for ids, at, k in ((a, i[g], p[g]), (b, j[g], q[g])))
        keys.append((x[:, None].astype(np.int64) * BASE + y).ravel())
        times.append((n[:, None] * m).ravel())
    links = np.where(large, 0, links)
    of = np.repeat(np.arange(len(links)), links)
    at = np.arange(len(of)) - np.repeat(np.cumsum(links) - links, links)
    keys.append(a[i[of] + at // q[of]].astype(np.int64) * BASE + b[j[of] + at % q[of]])
    times.append(np.ones(len(of), np.int64))
    if len(keys) == 1:
        return np.unique(keys[0], return_counts=True)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(times), len(found)).astype(np.int64)


def _align(texts: list[str], tools: Tokenizers) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups, pairs, times of each text."""
    done: dict[str, tuple] = {"": (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))}
    new = [t for t in dict.fromkeys(texts) if t]
    for t, (a, b) in zip(new, tools.ids(new), strict=True):
        if not len(a):
            done[t] = done[""]
            continue
        to_a, to_b = common_ends(tools.a_sizes[a], tools.b_sizes[b])
        i, j = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        p, q = to_a - i, to_b - j
        done[t] = (len(a), len(b), len(p), int((p * q).sum()), _spelled(a, b, i, j, p, q, tools), *_pairs(a, b, i, j, p, q))
    return [done[t] for t in texts]


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """docs plus n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`, the ids of each
    group in order) and pairs and times, the different linked pairs and their numbers.

    a_path is a byte-level .json file of tokenizers, b_path a .model file of
    sentencepiece, both where every executor can open them. Null and empty texts, and
    those whose tokens don't give back a blank and the text byte by byte, have no tokens:
    zeros, an empty groups and no pairs. Rows are independent: repeated rows and null ids
    pass through. Columns of docs named like the results are replaced."""
    names = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "pairs": "array<long>", "times": "array<long>"}
    plain = docs.drop(*[c for c in names if c != text])
    at = plain.columns.index(text)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _loaded:
            _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
        tools = _loaded[a_path, b_path]

        def done(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            *counts, said, pairs, times = zip(*_align(texts, tools), strict=True)
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(part))) for part in (pairs, times)]
            columns = [c for i, c in enumerate(batch.columns) if keep[i]]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.int64()) for c in counts], pa.array(said, pa.string()), *lists],
                                              [*[n for i, n in enumerate(batch.schema.names) if keep[i]], *names])

        for batch in batches:
            keep = [n not in names for n in batch.schema.names]
            first, size, texts = 0, 0, []
            for i, t in enumerate(batch.column(at)):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= _CHARACTERS_AT_ONCE or i + 1 == batch.num_rows:
                    yield done(batch.slice(first, i + 1 - first), texts)
                    first, size, texts = i + 1, 0, []

    kept = [f for f in plain.schema if f.name not in names]
    return plain.mapInArrow(align, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{n} {t}" for n, t in names.items()]]))


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (how many rows of aligned() hold it), best (whether none of its a has more)."""
    counts = stage(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    most = counts.groupBy(F.floor(F.col("pair") / BASE).alias("a")).agg(F.max("n").alias("most"))
    # one row for each id of a at most: the vocabulary bounds what is broadcast
    return stage(counts.withColumn("a", F.floor(F.col("pair") / BASE)).join(F.broadcast(most), "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(docs: DataFrame, a_path: str, b_path: str, text: str = "text", rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with their text replaced by the results of aligned() without pairs and times
    (groups as groups_sha256, empty without tokens), and n_best and count_sum: of how many
    links the pair's count over all rows is the highest of its a, and the sum of counts.

    The pairs of the highest counts, at most so many rows, are broadcast. The others meet
    by a shuffle, where no pair has many rows as each has a low count."""
    row = free_name(docs, "row")
    each = aligned(docs, a_path, b_path, text).withColumn(row, F.monotonically_increasing_id())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    names = [c for c in each.columns if c not in (text, "groups", "pairs", "times")]
    each = stage(each.select(*names, digest, "pairs", "times"), compression="zstd")
    counts = pair_counts(each)
    level = F.floor(F.log2("n")).cast("int").alias("level")
    room, least = rows, 63
    for r in counts.groupBy(level).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("level")).collect():
        room -= r.pairs
        if room < 0:
            break
        least = r.level
    frequent = F.floor(F.log2("n")) >= least
    links = each.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(row, "link.pairs", "link.times").withColumnRenamed("pairs", "pair")
    sums = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    met = links.join(F.broadcast(counts.where(frequent)), "pair").groupBy(row).agg(*sums)
    rare = counts.where(~frequent)
    if rare.limit(1).count():
        met = met.unionByName(links.join(rare.hint("merge"), "pair").groupBy(row).agg(*sums)).groupBy(row).agg(
            F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = each.drop("pairs", "times").join(met, row, "left").drop(row)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def query(spark, sf_dir):
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
