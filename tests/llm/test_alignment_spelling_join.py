"""Token alignment, spelling variants and the n-gram join against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lagwise.llm import alignment, ngram_join, queries, spelling
from lagwise.llm.common import table

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor " * 3_000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (None, "two words"), (6, None), (7, LONG), (4, "one"), (8, "éè \U0001f600 x"), (9, "a\x0bb\x85c d"), (10, "ONE")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"n_a": F.lit("x"), "id": F.lit(1), "row": F.lit("y"), "key": F.lit(2)})


@pytest.fixture(scope="module")
def tools():
    return alignment.Tokenizers(A, B)


def simple_groups(text, tools):
    """Ids of each group by plain sets of ends, and none if the bytes aren't the text's."""
    if not text:
        return []
    ids = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    parts = [[tools.a_bytes[i] for i in ids[0]], [tools.b_bytes[i] for i in ids[1]]]
    if not b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode():
        return []
    out, cut = [[], []], [[], []]
    ends = [set(accumulate(map(len, p))) for p in parts]
    common = ends[0] & ends[1]
    for side in (0, 1):
        at = 0
        for i, p in zip(ids[side], parts[side], strict=True):
            cut[side].append(i)
            at += len(p)
            if at in common:
                out[side].append(cut[side])
                cut[side] = []
    return list(zip(*out, strict=True))


TEXTS = ["a  b", "  a", " ", "\n", " \n x", "foo\n  bar \t\tq ", "x　 y z", "a\x1c b", "<|endoftext|> x <s> y</s>", "日本語 テキスト", "a\xa0 b", "\x85 a", "ab" * 900, "!" * 900 + "a" * 900,
         "tail  ", "\t", "don't we'LL I'm", " 12 ² ½ x", "\x00a b\x00", "ﬁ", "é x", "▁ a ▁b", "a▁ b", "\U0001f937\U0001f3fd‍ x", "ẞ Ա Ꟁ ౝ"]


def test_alignment_of_texts(tools):
    for t, got in zip(TEXTS, alignment._align(TEXTS, tools), strict=True):
        want = simple_groups(t, tools)
        links = Counter(a * alignment.BASE + b for x, y in want for a in x for b in y)
        assert got[:4] == (sum(len(x) for x, _ in want), sum(len(y) for _, y in want), len(want), sum(links.values())), t
        assert got[4] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want)
        assert dict(zip(got[5].tolist(), got[6].tolist(), strict=True)) == links


def test_quick_encoder_is_the_same(tools):
    marks = [*range(1, 0x250), *range(0x2013, 0x2027)]
    texts = [" " + f.format(c=chr(c)) for c in marks for f in ("a{c}b", "a {c}b", "{c}{c} {c}1", "1{c}2 !{c}!", " {c} ")]
    texts = [t for t in texts if alignment._SETTLED.fullmatch(t)]
    assert tools.quick is not None and len(texts) > 1000
    assert [tools.quick.encode_ordinary(t) for t in texts] == [e.ids for e in tools.a.encode_batch(texts, add_special_tokens=False)]


def test_groups_with_many_links(tools, monkeypatch):
    want = alignment._align(["\U0001f600" * 40 + " naïve", "日本語" * 30], tools)
    monkeypatch.setattr(alignment, "LARGE", 1)
    for a, b in zip(want, alignment._align(["\U0001f600" * 40 + " naïve", "日本語" * 30], tools), strict=True):
        assert a[:5] == b[:5] and dict(zip(a[5], a[6], strict=True)) == dict(zip(b[5], b[6], strict=True))


@pytest.mark.parametrize("rows", [500_000, 40])
def test_alignment_query(spark, tools, rows):
    """All columns of all documents; with 40 rows to broadcast most pairs meet by the shuffle."""
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()][:60] + ODD
    each = [simple_groups(t, tools) for _, t in docs]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in each]
    held = Counter(p for c in links for p in c)
    most: dict = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    want = []
    for (i, _), g, c in zip(docs, each, links, strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        want.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if held[p] == most[p[0]]),
                     sum(n * held[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_a": F.lit("x"), "row": F.lit("y")}).repartition(5)
    got = alignment.scored(df, A, B, rows=rows)
    assert "row" in got.columns
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.select(names).collect()))) == sorted(map(repr, want))


def test_alignment_odd(spark, odd):
    out = alignment.scored(odd, A, B)
    assert out.count() == len(ODD) and alignment.scored(odd.limit(0), A, B).count() == 0
    assert {r.groups_sha256 for r in out.where("doc_id in (1, 2, 6)").collect()} == {""}


# 12


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    n = Counter()
    for i, t in docs:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    cut: dict = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            cut.setdefault(v, set()).add(w)
    near: dict = {w: set() for w in words}
    for group in cut.values():
        for a in group:
            near[a] |= {b for b in group if b != a and b not in near[a] and one_edit(a, b)}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), k, len(near[w]), words[form[w]] if w in form else None) for w, k in words.items())


def test_near_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(500)}
    words |= {"a" * k for k in range(1, 14)} | {"a" * k + "b" for k in range(1, 9)} | {"b" + "a" * k for k in range(1, 9)}
    words = sorted(words)
    want = sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    for most in (20_000, 4):
        assert sorted((r.word, r.other) for r in spelling.near_words(df, most).collect()) == want


def test_acceptor_is_minimal():
    words = sorted(["abc", "abd", "xbc", "xbd", "b"])
    a = spelling.Acceptor(words)
    assert len(a.arcs) == 4 and sorted(a.near()) == [("abc", "abd"), ("abc", "xbc"), ("abd", "xbd"), ("xbc", "xbd")]
    for w in words:
        s = a.start
        for c in w:
            s = a.arcs[s][c]
        assert a.final[s]
    assert list(spelling.Acceptor(["same"]).near()) == []


def test_variants(spark):
    rng = random.Random(7)
    frequent = ["".join(rng.choice("etaoinsré") for _ in range(rng.randint(6, 11))) for _ in range(30)]
    docs = []
    for i in range(400):
        own = [rng.choice(frequent[: 1 + int(30 * rng.random() ** 3)]) for _ in range(12)]
        if rng.random() < 0.3:
            w = rng.choice(own)
            k = rng.randrange(len(w))
            own.append(rng.choice([w[:k] + "z" + w[k:], w[:k] + "q" + w[k + 1 :]]))
        docs.append((i if rng.random() > 0.02 else None, rng.choice([" ", ", ", "1"]).join(rng.choice([w, w.upper() if "é" not in w else w, w.capitalize()]) for w in own)))
    docs += [(900, "lengthened " * 40), (901, "lengthend " * 4), (902, "lengthnd lengthnd"), (903, None), (904, "×××÷÷÷ÀÀ ×××÷÷÷ÀÀ")]
    want = brute_variants(docs + docs[:5])
    assert sum(w[1] is not None for w in want) > 20
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").withColumn("word", F.lit(1)).repartition(4)
    for most in (20_000, 3):
        got = sorted((tuple(r) for r in spelling.variants(df, most=most).select("word", "form", "root", "n", "n_near", "form_n").collect()))
        assert got == want


def test_roots_follow_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w5"), ("y", "z")], "word string, form string")
    assert {r.word: r.root for r in spelling.rooted(forms).collect()} == {**{f"w{i}": "w11" for i in range(11)}, "x": "w11", "y": "z"}


def test_variants_of_documents(spark, odd):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = queries.queries()["op12_spelling_variants"](spark, SF)
    assert sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute_variants(docs)
    assert spelling.variants(odd.limit(0)).count() == 0 and spelling.variants(odd).count() == 0


# 13


def brute_join(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(ngram_join._LOWER).split()
        sets.append(frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset())
    p = list(range(len(rows)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    links = 0
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                links += sets[a] != sets[b]
                x, y = find(a), find(b)
                p[max(x, y)] = min(x, y)
    roots: dict = {}
    for k in range(len(sets)):
        roots.setdefault(find(k), []).append(k)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in roots[find(k)] if rows[j][0] is not None] if sets[k] else [i]
        out.append((i, len(sets[k]), min(ids) if ids and ids[0] is not None else None))
    return sorted(map(repr, out)), links


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(5)
    lexicon = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(30):
        base = [rng.choice(lexicon) for _ in range(rng.choice([1, 3, 4, 5, 20, 90, 150, 200]))]
        for c in range(rng.choice([1, 2, 5]) if g % 8 else 60):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + rng.randint(0, 1)] = [rng.choice(lexicon)] * rng.randint(0, 1)
            rows.append((len(rows), " ".join(w).upper() if c % 3 == 1 else "\n".join(w)))
    rows += [*ODD, (None, None), (None, "one"), (None, "nobody else says this at all")]
    rng.shuffle(rows)
    return rows, *brute_join(rows)


@pytest.mark.parametrize("cells,crowded", [(1 << 18, 32), (16, 2)])
def test_join_like_brute_force(spark, copied, cells, crowded, monkeypatch):
    rows, want, links = copied
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "n": F.lit("y"), "key": F.lit(1)}).repartition(5)
    assert links > 30
    assert sorted(repr(tuple(r)) for r in ngram_join.joined(df, cells=cells).collect()) == want


def test_join_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = queries.queries()["op13_ngram_join"](spark, SF)
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute_join(rows)[0]
    assert ngram_join.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_positional_filter_keeps_links(spark):
    """A pair at exactly 85 per cent passes, one shingle less does not."""
    common, own = [f"c{i}" for i in range(88)], ["x", "y", "z"]
    rows = [(1, " ".join(common)), (2, " ".join([*own, *common])), (3, " ".join([*common[:70], "o", *common[71:]]))]
    got = {r.doc_id: r.component_id for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, _ = brute_join(rows)
    assert sorted(repr((i, n, got[i])) for i, n in ((r.doc_id, r.n_shingles) for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want
