"""Spelling variants: all pairs of words one edit apart, by composing a minimised
acceptor of the vocabulary with a one-edit transducer and the acceptor again.

The composition's initial states deal its work out. Paths that read the same DEPTH letters
on both sides, without an edit, are a partition of their own for each such prefix: there
the acceptor of the words' rests is built, minimised, and composed. On paths with their
edit among the first letters both sides must read the same rest after it, so these words
meet by a join on what remains of them without the edited letter. A prefix with too many
words is dealt out again by the letters that follow, in the same two ways."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage, unstage

#: Code points of the shortest word, and occurrences of the rarest.
SHORTEST, RAREST = 7, 2
#: A form has so many times the word's occurrences or more.
TIMES = 10
#: One in so many runs of a document loses a code point.
DROPS = 31
#: Letters that a partition's words have in common at first, and more at each further deal.
DEPTH = 3
#: Words that one acceptor holds at most.
WORDS = 20_000
_COUNTED_AT_ONCE = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")


def written(doc_id, run: str) -> str:
    """What a document's run counts as: one in DROPS, by the crc32 of id and run, loses the
    code point at that number modulo its length."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DROPS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of SHORTEST or more code points that occur RAREST times or more.

    Words are runs of Latin letters, A-Z lower-cased, as written() gives them. A null text
    has none; a null id is written as nothing; rows that repeat count as often as they do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                i, t = i.as_py(), t.as_py()
                for run, n in Counter(_RUN.findall(t.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"))).items():
                    total[written(i, run)] += n
                if len(total) > _COUNTED_AT_ONCE:
                    yield done()
        yield done()

    runs = docs.where(F.col(text).isNotNull()).select(doc_id, text).mapInArrow(count, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where((F.char_length("word") >= SHORTEST) & (F.col("n") >= RAREST))


class Acceptor:
    """The smallest acyclic automaton of some words, given in order. State 0 has no arcs
    and accepts; a state's arcs lead to states of lower numbers."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [True]
        self._same = {(True, ()): 0}
        open_: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        before = ""
        for w in words:
            k = 0
            while k < len(before) and k < len(w) and before[k] == w[k]:
                k += 1
            self._close(open_, before, k)
            open_ += [({}, [False]) for _ in w[k:]]
            open_[-1][1][0] = True
            before = w
        self._close(open_, before, 0)
        self.start = self._state(*open_[0])

    def _close(self, open_, word: str, depth: int) -> None:
        while len(open_) > depth + 1:
            state = self._state(*open_.pop())
            open_[-1][0][word[len(open_) - 1]] = state

    def _state(self, arcs: dict[str, int], final: list[bool]) -> int:
        key = final[0], tuple(arcs.items())
        if key not in self._same:
            self._same[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final[0])
        return self._same[key]

    def shared(self, a: int, b: int) -> list[str]:
        """The rests that both states accept."""
        out, todo = [], [(a, b, "")]
        while todo:
            a, b, rest = todo.pop()
            if self.final[a] and self.final[b]:
                out.append(rest)
            x, y = self.arcs[a], self.arcs[b]
            todo += [(x[c], y[c], rest + c) for c in (x if x is y else x.keys() & y.keys())]
        return out

    def edits(self, state: int) -> list[tuple[str, str]]:
        """The pairs of rests that the one-edit transducer relates with its edit at their
        first letter: another letter in its place, or that letter only in the first."""
        arcs = self.arcs[state]
        out = [(c + s, d + s) for (c, p), (d, q) in combinations(arcs.items(), 2) for s in self.shared(p, q)]
        # where the next letter is the same, the pair counts at a later one
        return out + [(c + s, s) for c, p in arcs.items() for s in self.shared(p, state) if s[:1] != c]

    def near(self) -> Iterator[tuple[str, str]]:
        """The pairs of accepted words that are one edit apart, each once: the composition's
        accepted paths. The edit is at the first letter in which the two differ."""
        own = [self.edits(s) for s in range(len(self.arcs))]
        busy = [bool(x) for x in own]
        for s, arcs in enumerate(self.arcs):  # arcs lead to lower states
            busy[s] = busy[s] or any(busy[t] for t in arcs.values())
        todo = [(self.start, "")]
        while todo:
            state, read = todo.pop()
            for x, y in own[state]:
                yield read + x, read + y
            todo += [(t, read + c) for c, t in self.arcs[state].items() if busy[t]]


_PAIR = "word string, n long, other string, m long"


def _composed(words: DataFrame) -> DataFrame:
    """The pairs within each partition (key, word, n; a key's words begin alike)."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if len(part) > 1:
                pairs = list(Acceptor(list(part)).near())
                a, b = [x for x, _ in pairs], [y for _, y in pairs]
                n, m = [part[x] for x in a], [part[y] for y in b]
                for columns in ([a, n, b, m], [b, m, a, n]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], ["word", "n", "other", "m"])

        for batch in batches:
            for k, w, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    yield from done()
                    key, part = k, {}
                part[w] = n
        yield from done()

    dealt = words.select("key", "word", "n").repartition("key").sortWithinPartitions("key", "word")
    return dealt.mapInArrow(compose, _PAIR)


def _met(words: DataFrame, first: int, count: int) -> DataFrame:
    """The pairs of words (word, n) whose first difference is at a letter from `first` on,
    among `count` of them, and that are equal after it. What is left of a word
    without such a letter, or the whole word, is shared by as many words as there are
    letters at most, for each place."""
    cut = words.where(F.char_length("word") > first).select("word", "n", F.explode(F.expr(
        f"transform(sequence({first}, least({first + count}, char_length(word)) - 1), "
        "p -> struct(p as at, concat(substring(word, 1, p), substring(word, p + 2)) as rest))")).alias("c")).select("word", "n", "c.at", "c.rest")
    whole = words.select(F.col("word").alias("other"), F.col("n").alias("m"), F.col("word").alias("rest"))
    letter = lambda w: F.substring(w, F.col("at") + 1, F.lit(1))
    # the shorter word of an insertion is the rest itself; the first difference is there if the next letters differ
    put_in = cut.join(whole, "rest").where(letter("word") != letter("other")).select("word", "n", "other", "m")
    alike = cut.groupBy("at", "rest").agg(F.collect_list(F.struct("word", "n")).alias("all")).where(F.size("all") > 1)
    replaced = alike.select("all", F.explode("all").alias("one")).select("one", F.explode("all").alias("two")).where("one.word <> two.word").select(
        F.col("one.word").alias("word"), F.col("one.n").alias("n"), F.col("two.word").alias("other"), F.col("two.n").alias("m"))
    return replaced.unionByName(put_in).unionByName(put_in.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def near_words(words: DataFrame, most: int = WORDS) -> DataFrame:
    """word, n, other, m: each pair of different words of `words` (word, n; no word twice)
    that are one inserted, deleted or replaced code point apart, both ways round."""
    found, level, left = [], 0, words
    while True:
        found.append(_met(left, level, DEPTH))
        level += DEPTH
        keyed = left.where(F.char_length("word") >= level).withColumn("key", F.substring("word", 1, level))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        large = stage(sizes.where(F.col("size") > most).select("key"))
        if not large.limit(1).count():
            found.append(_composed(keyed))
            break
        # so many prefixes have more than `most` words each: a small part of the words
        found.append(_composed(keyed.join(broadcast_if_small(large), "key", "left_anti")))
        left = stage(keyed.join(broadcast_if_small(large), "key", "left_semi").select("word", "n"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): where following forms from word ends. Each step
    goes to a word of more occurrences, so there are no rings; each round doubles the way."""
    cur = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(cur.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        unstage(cur)
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        cur = after.select("word", "root")
        cur.staged_at = after.staged_at


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of vocabulary(docs).

    form is the near word of most occurrences (ties: the smallest by code points), if it
    has TIMES times the word's or more, root the last of the forms that follow, or the
    word. A table without texts or words gives no rows; other columns of docs are ignored."""
    words = stage(vocabulary(docs, doc_id, text))
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best")
    near = near_words(words, most).groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best)
    has = -F.col("best.less") >= TIMES * F.col("n")
    near = stage(near.select("word", "n_near", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    roots = rooted(near.where("form is not null"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark, sf_dir):
    from .common import table

    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
