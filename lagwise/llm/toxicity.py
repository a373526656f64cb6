"""Toxicity: a subsequence string kernel support vector machine with Nystroem
landmarks, trained on sentences.

The kernel of two words sums, over all gapped subsequences of three letters, the
product of their weights in both; a subsequence weighs DECAY to the power of the
span that it takes, so words with letters put in or left out stay similar. The mean of two
powers of the similarity, one that tolerates changes and one that hardly does, is the words'
kernel; similarities under FLOOR are none, in texts and in the landmarks' own matrix alike. The
kernel of two sentences sums that of their different words; its Nystroem map is the sum of a
sentence's words' kernels with each landmark, times the inverse square root of the landmarks'
kernel matrix, and a linear machine on it gives its margin. A text's most toxic sentence, with
a share of the margin of a logistic regression on the map of all its words, decides whether
it is toxic; among texts of one decision their sum ranks.

Landmarks are words that mark toxic texts, and words of clean texts that are similar to
one of them, so that the machine can tell `oron` from `moxron`."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage

#: Toxic landmarks, and clean ones beside them, at most.
LANDMARKS, BESIDE = 130, 150
#: Clean landmarks beside the same toxic one, at most.
EACH = 8
#: A landmark stands in at least so many texts of the fit.
LANDMARK_TEXTS = 3
#: Standard deviations over chance that a word of a toxic landmark has at least: of 100,000
#: words that mark nothing, less than one gets there.
SURE = 4.5
#: A clean word of such a similarity to a toxic landmark may be a landmark too.
ALIKE = 0.5
#: The fit uses at most so many labelled rows, the first by a hash of their id.
FIT_ROWS = 8_000
DECAY, SPAN = 0.8, 6
#: The words' kernel is the mean of these powers of the similarity.
POWERS = (2, 10)
#: Similarities below this count as none, of landmarks too.
FLOOR = 0.5
#: All clean sentences weigh so many times all toxic ones in the fit.
CLEAN = 30.0
#: The squared weights' share of the machine's loss.
RIDGE = 1e-4
#: What the whole text's margin counts beside the most toxic sentence's in the decision.
WHOLE = 0.2
#: The share of the fit's clean texts that may score 0.5 or more.
FALSE = 0.0075
#: Words of a sentence at most; longer ones are cut.
SENTENCE = 40
#: Longer words are compared in pieces of this length that overlap by OVERLAP.
PIECE, OVERLAP = 32, 12
#: Words whose similarities one Python worker remembers.
REMEMBER = 200_000
_WORDS_AT_ONCE = 4_096
#: Examples, of some 250 numbers each, that a worker gathers before it passes them on.
EXAMPLES_AT_ONCE = 1_000
_TRIPLES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)")
_DROPPED = re.compile(r"[^\w\s]+|_")
#: Digits and signs that stand in for letters; fixed values.
_STAND_INS = str.maketrans("013457@$", "oieastas")
#: What _DROPPED drops of ASCII, which translate takes out more quickly.
_ASCII_DROPPED = {i: None for i in range(128) if _DROPPED.fullmatch(chr(i))}
#: A blank that stands between sentences whose letters are read at once.
_BETWEEN = "\x1e"
#: Landmarks are kept in so many groups of similar ones.
GROUPS = 64
_known: dict = {}


@dataclass(frozen=True)
class KernelModel:
    landmarks: tuple[str, ...]
    #: The map, a row for each landmark; and weights on it, the offset last, of a sentence
    #: and of a whole text.
    root: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    #: From what margin on a text is toxic, and the middle of the margins that rank texts;
    #: score = sigmoid(slope * what a margin is over its cut).
    slope: float
    cut: tuple[float, float]

    @cached_property
    def along(self) -> np.ndarray:
        """The sentence's weights on the sums themselves."""
        return self.root @ self.sentence[:-1]

    def margins(self, rows: np.ndarray, whole: np.ndarray) -> list[float]:
        """What decides, that of a text's most toxic sentence and WHOLE of the whole text's, and
        what ranks, their sum, for the sums `rows` of its sentences and `whole` of all its
        words. A text has a sentence without a similar word too."""
        best = self.sentence[-1] + np.max(rows @ self.along, initial=0.0)
        text = self.text[-1] + _drawn_in(whole @ self.root) @ self.text[:-1]
        return [float(best + WHOLE * text), float(best + text)]


def _drawn_in(x: np.ndarray) -> np.ndarray:
    """Sums of many words, which would outgrow the rest, by their logarithm."""
    return np.sign(x) * np.log1p(np.abs(x))


def _kernel(similarity: np.ndarray) -> np.ndarray:
    s = np.where(similarity >= FLOOR, np.minimum(similarity, 1), 0)
    return sum(s**p for p in POWERS) / len(POWERS)


def _plain(text: str) -> str:
    t = text.lower()
    if "@" in t or "$" in t:
        t = re.sub(r"(?<=\w)[@$](?=\w)", lambda m: m[0].translate(_STAND_INS), t)
    return t.translate(_ASCII_DROPPED) if t.isascii() else _DROPPED.sub("", t)


def _tokens(text: str) -> list[str]:
    return _plain(text).split()


def _tokens_of(parts: list[str]) -> list[list[str]]:
    """The tokens of each part, whose letters are all read at once."""
    joined = _BETWEEN.join(parts)
    if not parts or joined.count(_BETWEEN) >= len(parts):  # some part has the mark itself
        return [_tokens(p) for p in parts]
    return [p.split() for p in _plain(joined).split(_BETWEEN)]


def _spelt(tokens: Iterable[str], different: set[str]) -> set[str]:
    """The runs of more than two single letters; different is the set of tokens."""
    out: set[str] = set()
    if list(map(len, different)).count(1) > 1:
        run: list[str] = []
        for w in [*tokens, ""]:
            if len(w) == 1:
                run.append(w)
            elif run:
                if len(run) > 2:
                    out.add("".join(run))
                run = []
    return out


def words(text: str | None) -> set[str]:
    """Lower-case words without signs; runs of single letters are one word, so a word
    that is spaced out letter by letter is seen whole."""
    tokens = _tokens(text or "")
    out = set(tokens)
    return {w for w in out | _spelt(tokens, out) if len(w) > 2}


def _pieces(word: str) -> list[str]:
    if not word.isalpha() and not word.isdigit():
        word = word.translate(_STAND_INS)
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - OVERLAP, PIECE - OVERLAP)]


def _cut(found: set[str]) -> set[str]:
    return {p for w in found for p in _pieces(w)}


def _letters(pieces: list[str]) -> np.ndarray:
    """A row of letter classes (1 to 63, 0 after the end) for each piece."""
    width = max(map(len, pieces))
    raw = np.frombuffer("".join(p.ljust(width, "\0") for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
    latin = (raw >= 97) & (raw <= 122)
    return np.where(raw == 0, 0, np.where(latin, raw - 96, 27 + raw * np.uint32(2654435761) % np.uint32(37))).astype(np.int64)


def subsequences(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece, subsequence, weight: each triple of letters of each piece once, in order."""
    if not pieces:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    c = _letters(pieces)
    rows, codes, weights = [], [], []
    for a, b in _TRIPLES:
        if c.shape[1] <= b:
            continue
        third = c[:, b:]
        n = third.shape[1]
        row, col = np.nonzero(third)
        rows.append(row)
        codes.append((c[:, :n][row, col] << 12) | (c[:, a : a + n][row, col] << 6) | third[row, col])
        weights.append(np.full(len(row), DECAY ** (b + 1)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key = (np.concatenate(rows) << 18) | np.concatenate(codes)
    found, at = np.unique(key, return_inverse=True)
    return found >> 18, found & 0x3FFFF, np.bincount(at, np.concatenate(weights), len(found))


class Landmarks:
    """The landmarks' subsequences, for the similarity of any words to each of them."""

    def __init__(self, names: tuple[str, ...]):
        row, code, weight = subsequences([_pieces(n)[0] for n in names])
        norm = np.sqrt(np.bincount(row, weight**2, len(names)))
        used, at = np.unique(code, return_inverse=True)
        self.place = np.full(1 << 18, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.of = np.zeros((len(used), len(names)), np.float32)
        np.add.at(self.of, (at, row), weight / norm[row])
        # the most that a subsequence adds to the similarity to any landmark
        self.peak = np.zeros(1 << 18, np.float32)
        self.peak[used] = self.of.max(axis=1)
        self.n = len(names)
        # groups about landmarks that are far from each other, and a group's peaks
        alike = self.of.T @ self.of
        centres, best = [0], alike[0].copy() if names else np.empty(0)
        while len(centres) < min(GROUPS, len(names)):
            centres.append(int(best.argmin()))
            best = np.maximum(best, alike[centres[-1]])
        group = alike[centres].argmax(axis=0) if names else np.empty(0, int)
        self.members = [m for g in range(len(centres)) if len(m := np.flatnonzero(group == g))]
        self.own = [np.ascontiguousarray(self.of[:, m]) for m in self.members]
        self.peaks = np.stack([o.max(axis=1, initial=0) for o in self.own], axis=1) if names else np.zeros((0, 0), np.float32)

    def gram(self) -> np.ndarray:
        """The kernel matrix of the landmarks, by the kernel that texts have."""
        return _kernel(self.of.T.astype(np.float64) @ self.of)

    def hopeful(self, pieces: list[str]) -> np.ndarray:
        """Which pieces may reach FLOOR: the sum of all that their subsequences can add
        is bounded, and so, by its number of letters, is a piece's own length."""
        c = _letters(pieces)
        size = np.array([len(p) for p in pieces])
        most, own = np.zeros(len(pieces), np.float32), np.zeros(len(pieces))
        for a, b in _TRIPLES:
            n = c.shape[1] - b
            if n > 0:
                most += self.peak[(c[:, :n] << 12) | (c[:, a : a + n] << 6) | c[:, b:]].sum(axis=1) * DECAY ** (b + 1)
                own += DECAY ** (2 * b + 2) * np.maximum(size - b, 0)
        return most >= FLOOR * np.sqrt(own) * 0.999

    def similar(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which words are similar to some landmark at all, and their kernels with each."""
        places, rows = [], []
        for first in range(0, len(found), _WORDS_AT_ONCE):
            part = found[first : first + _WORDS_AT_ONCE]
            cut = [_pieces(w) for w in part]
            owner = np.repeat(np.arange(len(part)), [len(p) for p in cut])
            pieces = [x for p in cut for x in p]
            near = np.flatnonzero(self.hopeful(pieces))
            owner = owner[near]
            row, code, weight = subsequences([pieces[i] for i in near])
            norm = np.sqrt(np.bincount(row, weight**2, len(owner)))
            at = self.place[code]
            hit = at >= 0
            row, at, weight = row[hit], at[hit], weight[hit].astype(np.float32)
            if not len(row):
                continue
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size, length = np.diff(np.r_[begin, len(row)]), norm[row[begin]].astype(np.float32)[:, None]
            # a group's peaks bound the similarity to each of its landmarks; only where the bound
            # reaches FLOOR can the kernel be other than none
            may = _sums(self.peaks, at, weight, begin, size) >= FLOOR * 0.999 * length
            sums = np.zeros((len(begin), self.n), np.float32)
            for members, own, open_ in zip(self.members, self.own, may.T, strict=True):
                if len(some := np.flatnonzero(open_)):
                    sums[np.ix_(some, members)] = _sums(own, at, weight, begin[some], size[some]) / norm[row[begin[some]], None]
            ok = (sums >= FLOOR).any(axis=1)
            best = np.zeros((len(part), self.n), np.float32)
            np.maximum.at(best, owner[row[begin[ok]]], _kernel(sums[ok]))
            some = np.unique(owner[row[begin[ok]]])
            places.append(first + some)
            rows.append(best[some])
        if not rows:
            return np.empty(0, np.int64), np.empty((0, self.n), np.float32)
        return np.concatenate(places), np.concatenate(rows)


def _sums(table: np.ndarray, at: np.ndarray, weight: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run of so many places from begin on, the sum of the table's rows at these, times their weights."""
    out = np.empty((len(begin), table.shape[1]), np.float32)
    for i in range(0, len(begin), 256):  # bounds the gathered rows
        n = size[i : i + 256]
        first = np.cumsum(n) - n
        places = np.arange(n.sum()) + np.repeat(begin[i : i + 256] - first, n)
        out[i : i + 256] = np.add.reduceat(table[at[places]] * weight[places, None], first)
    return out


def sentences(text: str) -> list[str]:
    """A text's sentences, cut to SENTENCE words."""
    out = []
    for part in _SENTENCE.split(text):
        if part:
            if len(part) > 4 * SENTENCE and len(w := part.split()) > SENTENCE:
                out += [" ".join(w[i : i + SENTENCE]) for i in range(0, len(w), SENTENCE)]
            else:
                out.append(part)
    return out


def _near(texts, names: tuple[str, ...]) -> Iterator[tuple[list[list[str]], bool, dict[str, np.ndarray]]]:
    """For each text its sentences' tokens, whether letters may be spelt out in it, and the
    similarities to each landmark of those words that have one. No token goes over the end
    of a sentence, so a text's tokens are those of its sentences."""
    key = hashlib.sha256("\0".join(names).encode("utf-8", "surrogatepass")).digest()
    if key not in _known:
        _known.clear()
        _known[key] = (Landmarks(names), set(), {})
    marks, known, near = _known[key]
    part: list[tuple[list[list[str]], bool, set[str]]] = []
    size = 0

    def done():
        new = set().union(*[found for _, _, found in part]) - known
        if len(known) + len(new) > REMEMBER:
            known.clear()
            near.clear()
            new = set().union(*[found for _, _, found in part])
        known.update(new)
        # words of about one length fill a table well; those of one or two letters are none
        new = sorted([w for w in new if len(w) > 2], key=len)
        at, rows = marks.similar(new)
        near.update(zip((new[i] for i in at), rows, strict=True))
        for tokens, spelling, found in part:
            yield tokens, spelling, {w: near[w] for w in near.keys() & found}

    for t in texts:
        tokens = _tokens_of(sentences(t))
        different = set(chain.from_iterable(tokens))
        runs = _spelt(chain.from_iterable(tokens), different)
        part.append((tokens, bool(runs), different | runs if runs else different))
        size += len(part[-1][2])
        if size > 20_000:
            yield from done()
            part, size = [], 0
    yield from done()


def _described(texts, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, a row for each of its sentences that has words similar to a landmark:
    the sums of their kernels with each; and that sum of all its words. Words that only the
    text as a whole has, spelled out over several sentences, are a sentence of their own."""
    for tokens, spelling, near in _near(texts, names):
        if not near:
            yield np.zeros((0, len(names))), np.zeros(len(names))
            continue
        place = {w: i for i, w in enumerate(near)}
        each = np.array(list(near.values()), np.float64)
        used, begin, left = [], [], set(near)
        for one in tokens:
            if not spelling and near.keys().isdisjoint(one):
                continue
            different = set(one)
            if own := near.keys() & (different | _spelt(one, different) if spelling else different):
                begin.append(len(used))
                used += [place[w] for w in own]
                left -= own
        if left:
            begin.append(len(used))
            used += [place[w] for w in left]
        yield np.add.reduceat(each[used], begin, axis=0), each.sum(axis=0)


def choose_landmarks(sample: DataFrame, count: int = LANDMARKS, texts: int = LANDMARK_TEXTS, beside: int = BESIDE) -> tuple[list[str], list[str]]:
    """The words of sample (text, label), long ones in pieces, that toxic texts hold most
    over chance, by SURE standard deviations or more; and the most frequent clean words
    beside each of them. Counts are sums by word over all of the sample."""
    total, toxic = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    rate = toxic / total

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(w, y) for t, y in zip(b["text"], b["label"], strict=True) for w in sorted(_cut(words(t)))]
            yield pd.DataFrame(found, columns=["word", "label"])

    tally = stage(sample.select("text", "label").mapInPandas(spread, "word string, label int").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")))
    over = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    top = tally.where((F.col("n") >= texts) & (over >= SURE)).orderBy(over.desc(), "word").limit(count)
    chosen = [r.word for r in top.collect()]
    if not chosen or not beside:
        return chosen, []
    names = tuple(chosen)

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = Landmarks(names)
        for b in batches:
            at, similar = marks.similar(list(b["word"]))
            yield b.iloc[at].assign(near=similar.max(axis=1), to=similar.argmax(axis=1))

    clean = tally.where((F.col("t") <= F.col("n") * (toxic / total)) & ~F.col("word").isin(chosen))
    own = Window.partitionBy("to").orderBy((F.col("n") * F.pow("near", F.lit(3))).desc(), "word")
    alike_enough = float(_kernel(np.array(ALIKE)))
    found = clean.mapInPandas(alike, "word string, n long, t long, near double, to int").where(F.col("near") >= alike_enough).withColumn("place", F.row_number().over(own))
    top = found.where(F.col("place") <= EACH).orderBy((F.col("n") * F.pow("near", F.lit(3))).desc(), "word").limit(beside)
    return chosen, [r.word for r in top.collect()]


def _altered(word: str) -> list[str]:
    """word with a letter put in, at four places, and one left out, at two, by a rule, as those
    who evade filters do."""
    inner = max(len(word) - 1, 1)
    places = [1 + (len(word) * 7 + k * 3) % inner for k in range(4)]
    return [*[word[:at] + c + word[at:] for at, c in zip(places, "xoea", strict=True)], *[word[:at] + word[at + 1 :] for at in places[:2]]]


def _examples(toxic: list[str], names: tuple[str, ...], root: np.ndarray):
    """Sentences as x, the map, label and weight. Of toxic texts those that hold a toxic landmark,
    and the landmark altered in its place; whether their others are toxic isn't known, and
    they are left out. Of clean texts all; those without a similar word are one example of
    their number's weight."""
    held = set(toxic)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts, labels, plain = [], [], 0
            for t, y in zip(b["text"], b["label"], strict=True):
                for part in sentences(t or ""):
                    if not y:
                        parts.append(part)
                        labels.append(0)
                    elif marks := sorted(_cut(words(part)) & held):
                        others = " ".join(sorted(words(part) - held))
                        for m in (part, *[f"{others} {x}" for m in marks for x in _altered(m)]):
                            parts.append(m)
                            labels.append(1)
            maps, own = [], []
            for (rows, whole), y in zip(_described(parts, names), labels, strict=True):
                if len(rows):
                    maps.append(whole @ root)
                    own.append(y)
                    if len(maps) == EXAMPLES_AT_ONCE:
                        yield pd.DataFrame({"x": maps, "label": own, "weight": 1.0})
                        maps, own = [], []
                else:
                    plain += 1 - y
            if maps:
                yield pd.DataFrame({"x": maps, "label": own, "weight": 1.0})
            if plain:
                yield pd.DataFrame({"x": [np.zeros(root.shape[1])], "label": [0], "weight": [float(plain)]})

    return examples


def _machine(found: DataFrame, width: int, most: int = 60) -> np.ndarray:
    """The weights, the offset last, of the linear support vector machine with squared hinge
    loss on found (x of so many numbers, label, weight), by Newton steps; each step's sums come
    from one job. The squared hinge holds altered insults to the margin as well as plain ones."""
    size = width + 1

    def summed(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, h = np.zeros(size), np.zeros((size, size))
            for b in batches:
                x = np.column_stack([np.stack(b["x"]), np.ones(len(b))])
                sign = 2.0 * b["label"].to_numpy() - 1
                short = 1 - sign * (x @ w)
                inside = short > 0
                own = x[inside] * b["weight"].to_numpy()[inside][:, None]
                g -= 2 * own.T @ (sign * short)[inside]
                h += 2 * own.T @ x[inside]
            flat = np.concatenate([g, h.ravel()])
            used = np.flatnonzero(flat)
            yield pd.DataFrame({"at": used, "sum": flat[used]})

        total = found.mapInPandas(sums, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).toArrow()
        flat = np.zeros(size + size * size)
        flat[total["at"].to_numpy()] = total["sum"].to_numpy()
        return flat[:size], flat[size:].reshape(size, size)

    w, ridge = np.zeros(size), np.append(np.full(width, RIDGE), 1e-9)
    for _ in range(most):
        g, h = summed(w)
        step = np.linalg.solve(h + 2 * np.diag(ridge), g + 2 * ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            return w
    raise RuntimeError(f"the machine did not settle in {most} steps")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = FIT_ROWS, count: int = LANDMARKS) -> KernelModel:
    """A model of labels (doc_id, label 0 or 1) by the texts of docs.

    Rows without id, label or document are left out; an id with several labels is
    toxic if one of them says so. Without both labels, or without a word that marks
    toxic texts, the model scores all texts alike. Only the sampled ids (at most
    rows) are broadcast, never texts."""
    rated = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    ids = stage(rated.orderBy(F.xxhash64(doc_id), doc_id).limit(rows))
    sample = stage(docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(ids), doc_id).select("text", "label"))
    seen = {r.label for r in sample.select("label").distinct().collect()}
    toxic, beside = choose_landmarks(sample, count) if seen == {0, 1} else ([], [])
    if not toxic:
        none = np.zeros((0, 0))
        return KernelModel((), none, np.zeros(1), np.zeros(1), 1.0, (0.0, -10.0 if seen == {1} else 10.0))
    names = (*toxic, *beside)
    value, vector = np.linalg.eigh(Landmarks(names).gram())
    # directions that the landmarks don't tell apart from rounding, or that the floor bends, have no part in the map
    firm = value > 1e-3 * value[-1]
    root = vector[:, firm] @ np.diag(value[firm] ** -0.5)
    found = stage(sample.mapInPandas(_examples(toxic, names, root), "x array<double>, label int, weight double"))
    most = {r.label: r.w for r in found.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    weight = F.col("weight") * F.when(F.col("label") == 1, 1 / most.get(1, 1.0)).otherwise(CLEAN / most.get(0, 1.0))
    machine = _machine(found.coalesce(4).select("x", "label", weight.alias("weight")), root.shape[1])

    @F.pandas_udf("array<double>")
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_drawn_in(whole @ root).tolist() for _, whole in _described([t or "" for t in s], names)])

    n = sample.count()
    each = stage(sample.select("text", F.col("label").cast("double").alias("label"), mapped("text").alias("x")))
    texts = LogisticRegression(regParam=1 / n, standardization=False).fit(each.coalesce(4).select(array_to_vector("x").alias("features"), "label"))
    weights = [machine, np.append(texts.coefficients.toArray(), float(texts.intercept))]
    raw = KernelModel(names, root, *weights, 1.0, (0.0, 0.0))
    margins = stage(each.select(_margins(raw)("text").alias("z"), "label"))
    platt = LogisticRegression(regParam=1e-4).fit(margins.select(array_to_vector(F.array(F.get("z", F.lit(1)))).alias("features"), "label"))
    cut = margins.where("label = 0").agg(*[F.percentile(F.get("z", F.lit(i)), F.lit(1 - FALSE)) for i in (0, 1)]).first()
    # a text without a similar word is never toxic
    bare = raw.margins(np.zeros((0, len(names))), np.zeros(len(names)))
    return KernelModel(names, root, *weights, max(float(platt.coefficients[0]), 1e-6), tuple(max(float(c), b) + 1e-9 for c, b in zip(cut, bare, strict=True)))


def _margins(model: KernelModel):
    """A pandas UDF of the margins of texts."""

    @F.pandas_udf("array<double>")
    def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([model.margins(*x) for x in _described([t or "" for t in s], model.landmarks)])

    return margins


def score(docs: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 if score >= 0.5).

    Null and empty texts are similar to no landmark and have the score of a text without.
    Rows are independent; repeated rows and null ids pass through."""
    if not model.landmarks:
        z = F.lit(-model.cut[1])
    else:
        found = free_name(docs, "margins")
        decides, ranks = (F.get(F.col(found), F.lit(i)) - c for i, c in enumerate(model.cut))
        docs = docs.withColumn(found, _margins(model)(F.col(text)))
        z = F.when(decides >= 0, F.greatest(decides, ranks)).otherwise(F.least(ranks, F.lit(-1e-6))) * model.slope
    out = docs.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.drop(found) if model.landmarks else out


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
