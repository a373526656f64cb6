"""Token counts: pieces are counted once per distinct pre-token and summed by
each document's pre-token frequencies; no list of ids is ever built.

The pre-token is a whitespace-delimited word. Only tokenizers are taken that drop white
space and never look over it, so a word has the same pieces wherever it stands; others,
in whose tokens blanks have a part, are refused. A task counts each distinct word of
an Arrow batch once (and remembers words between batches, up to a bound), joins
these counts with the documents' word frequencies, and adds them up. This needs
no shuffle: at any scale the cost is one pass over the texts. Distinct words of all
texts joined by shuffle were tried: most words are rare, so 0.51 GB of documents gave
16 million distinct words and 27 million pairs of a rare word and a document, 1.4 GB of
shuffles and over 1.1 GB of disk before the last join, where 1.5 x the input is allowed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space for every tokenizer at hand; the rest is left to the tokenizer.
_BLANK = re.compile(r"[ \t\n\r]+")
#: Words remembered by one Python worker; beyond it the memory starts afresh.
REMEMBER = 300_000
#: Longer words are counted but not remembered.
REMEMBER_CHARS = 64
#: Words of letters, digits, signs, marks and other scripts, in neighbourhoods where patterns
#: that look over blanks would show.
_PROBE = ("word", "it's", "12", "34", "5", ".", ",", "--", "(", ")", "'", "s", "'s", "A", "Bc", "\u00e9", "e\u0301", "\u0301", "\u4e2d\u6587", "\u3042", "\U0001f600", "_", "a_b", "x1", "end")
_loaded: dict = {}


def drops_blanks(tokenizer) -> bool:
    """Whether each blank ends a pre-token and is in none: the pre-tokenizer, after the
    normaliser, makes of words between blanks what it makes of each of them; no added token
    holds a blank."""
    if tokenizer.pre_tokenizer is None or any(_BLANK.search(t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        return False

    def pieces(text: str) -> list[str]:
        if tokenizer.normalizer is not None:
            text = tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    each = [pieces(w) for w in _PROBE]
    return all(pieces(blank + blank.join(_PROBE) + blank) == sum(each, []) for blank in (" ", "  ", "\t", "\n", "\r", "\r\n", " \n"))


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        if not drops_blanks(t):
            raise ValueError(f"{path}: its tokens may hold or span blanks, so words can't be counted one by one")
        _loaded[path] = (t, {})
    return _loaded[path]


def _pieces(tokenizer, words: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def _count(texts: list[str], path: str) -> list[int]:
    tokenizer, known = _tokenizer(path)
    frequencies = [Counter(_BLANK.split(t)) for t in texts]
    new = list({w for f in frequencies for w in f} - known.keys())
    fresh = {}
    for i in range(0, len(new), 10_000):
        part = new[i : i + 10_000]
        fresh.update(zip(part, _pieces(tokenizer, part), strict=True))
    if len(known) + len(fresh) > REMEMBER:
        keep = {w: known[w] for f in frequencies for w in f if w in known}
        known.clear()
        fresh.update(keep)
    out = [sum(n * (fresh[w] if w in fresh else known[w]) for w, n in f.items()) for f in frequencies]
    known.update((w, n) for w, n in fresh.items() if len(w) <= REMEMBER_CHARS)
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs plus n_bytes (UTF-8 length of the text), n_tokens and over_limit.

    tokenizer_path names a tokenizers .json file that every executor can open
    (installed beside the library, or shipped with the job); one whose tokens may hold
    or span blanks is refused with a ValueError. A null text counts as empty: 0 bytes, 0 tokens. Rows are neither joined nor grouped, so repeated
    rows and null ids pass through; columns of docs named like the results are
    replaced.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            done: list[int] = []
            part: list[str] = []
            size = 0
            for t in s:
                part.append(t)
                size += len(t)
                if size > 4_000_000:
                    done += _count(part, tokenizer_path)
                    part, size = [], 0
            done += _count(part, tokenizer_path)
            yield pd.Series(done, dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": n_tokens(whole)}).withColumn(
        "over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir):
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")
