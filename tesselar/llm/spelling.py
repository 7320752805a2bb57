"""Spelling variant grouping by a rare-first prefix filter on positional bigrams.

1. Texts are cut into words and counted in their tasks; counts are added up in a shuffle.
2. The bigrams of all words (at most 90 * 90, whatever the input is) are counted, and order the bigrams of a word from rare to frequent.
3. One insertion, deletion or replacement spoils at most two bigrams of either word, and moves the others by at most one place. In the global
   order the first bigram that both keep is therefore among the first three of both, so words meet by their three rarest, with equal
   places, or one place further in the longer word.
4. What meets is verified: the words agree up to a change in the first half, or from a change in the second half on, and have an edit
   distance of 1. Only verified pairs leave the join.
5. A word's form is its most frequent neighbour, if that is frequent enough; roots are found by doubling the reach of pointers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidied

#: Least code points and occurrences of a word, least ratio of a form's occurrences to the word's.
LEAST_LENGTH, LEAST_TIMES, RATIO = 7, 2, 10
#: Rarest bigrams by which words meet: one more than an edit spoils.
RAREST = 3
#: Of the noise: one run in so many loses a letter.
NOISE = 31
_HELD = 300_000

#: Bytes of Latin-1: A-Z lower-cased, the letters' block from U+00C0 as it is, all others blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, a byte a code point."""
    # other characters become "?", which is no letter
    return text.encode("latin-1", "replace").translate(_WORD_BYTES).split(b" ") if text else []


def noisy(run: bytes, start: int, every: int) -> bytes:
    """The run, without one code point if ``every`` divides the crc32 of the id, a colon and the run. ``start``: the crc32 up to the run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str, text_col: str, least: int, every: int) -> DataFrame:
    """(word, n) of all words of at least ``least`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                for w, n in Counter(runs_of(text)).items():
                    if len(w) >= least:
                        w = noisy(w, start, every)
                        if len(w) >= least:
                            total[w] = total.get(w, 0) + n
                if len(total) >= _HELD:
                    yield out()
                    total.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 bytes of all words one after another, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), lengths


def _bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, owner and place of every bigram."""
    flat, lengths = _codes(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = owner[1:] == owner[:-1]
    return (flat[:-1].astype(np.int64) << 8 | flat[1:])[inside], owner[:-1][inside], place[:-1][inside]


def bigram_counts(words: DataFrame) -> np.ndarray:
    """How many bigrams of the words have each code: 65,536 numbers, of which at most 90 * 90 aren't 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(_bigrams(batch.column(0).to_pylist())[0], minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in words.select("word").mapInArrow(tidied(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


#: Places and lengths in a key; beyond that words meet more often than they need to.
_FIELD = (1 << 20) - 1


def rarest(words: DataFrame, counts) -> DataFrame:
    """(word, n, keys, longer): keys of the three rarest bigrams with their places, for words of the same length, and for words with one
    letter more, in which a bigram may have moved by one place."""
    names = ["word", "n", "keys", "longer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            code, owner, place = _bigrams(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            order = np.lexsort((place, code, counts.value[code], owner))
            first = np.searchsorted(owner, np.arange(len(words)))  # owners rise, before and after sorting
            few = np.minimum(lengths - 1, RAREST)
            pick = order[np.repeat(first, few) + np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few)]
            code, owner, place = code[pick], owner[pick], place[pick]
            key = lambda p, n: code << 40 | np.minimum(p, _FIELD) << 20 | np.minimum(n, _FIELD)
            longer = np.stack([key(place, lengths[owner] + 1), key(place + 1, lengths[owner] + 1)], 1).ravel()
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(few * k)].astype(np.int32)), pa.array(v)) for v, k in ((key(place, lengths[owner]), 1), (longer, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=names)

    return words.mapInArrow(tidied(run), "word string, n long, keys array<long>, longer array<long>")


def _halves(prefix: str, word: Column, shorter: Column) -> list[Column]:
    """Hashes of the first half of ``shorter`` characters and of the rest, counted from the end."""
    half = F.floor(shorter / 2).cast("int")
    return [F.xxhash64(F.substring(word, F.lit(1), half)).alias(f"{prefix}head"), F.xxhash64(F.right(word, (shorter - half).cast("int"))).alias(f"{prefix}tail")]


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, na, b, nb), each unordered pair of words with an edit distance of 1 once."""
    counts = bigram_counts(words)
    rows = scratch.save(rarest(words, words.sparkSession.sparkContext.broadcast(counts)), "rarest")
    size = F.length("word")
    index = lambda shorter: rows.select(F.col("word").alias("b"), F.col("n").alias("nb"), *_halves("b", F.col("word"), shorter), F.explode("keys").alias("key"))
    probe = lambda keys: rows.select(F.col("word").alias("a"), F.col("n").alias("na"), *_halves("a", F.col("word"), size), F.explode(keys).alias("key"))
    agree = (F.col("ahead") == F.col("bhead")) | (F.col("atail") == F.col("btail"))
    near = agree & (F.levenshtein("a", "b", 1) == 1)
    same = probe("keys").join(index(size), "key").where((F.col("a") < F.col("b")) & near)
    more = probe("longer").join(index(size - 1), "key").where(near)
    both = [df.select("a", "na", "b", "nb") for df in (same, more)]
    return scratch.save(both[0].unionByName(both[1]).distinct(), "near")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for rows (word, form): the last of a chain of forms. Forms are more frequent than their words, so no chain closes; the
    reach of a pointer doubles in each round."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = scratch.save(now, "roots")
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row a word of at least ``least_length`` code points and ``least_times`` occurrences.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; one run in ``noise``, chosen by the crc32 of id and run, loses a
    code point. Words with an edit distance of 1 are near; a word's form is the near word with most occurrences (the smallest, if several
    have them), if these are at least ``ratio`` times its own; its root is the last of the chain of forms, or the word. Null ids count as
    empty ones; null and empty texts have no words; long texts and words are taken whole; equal ids and repeated rows count as rows of
    their own; an empty table gives an empty result. No other column is read.
    """
    if least_length < RAREST + 1:
        raise ValueError("words that short have fewer bigrams than an edit may spoil")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(count_words(docs, id_col, text_col, least_length, noise).where(F.col("n") >= least_times), "words")
    near = near_pairs(words, scratch)
    sides = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = words.join(best, "word", "left")
    good = -F.col("best.m") >= ratio * F.col("n")
    found = scratch.save(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "found")
    last = roots(found.where("form is not null"), scratch)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
