"""Benchmark decontamination by spaced-seed hashing.

Words of tests and documents are hashed under fixed masks that ignore some positions, so that a substituted word does not
hide a match. Equal seeds give an alignment; along it the longest run of words of which a given share is equal is verified
word by word. The masks follow from the rule: every aligned run of 13 words or more with at least 80 % equal has a seed of MASKS
(a run of 26 or more has a half that is as good, so 13 to 25 words are all cases), and a shorter test, which counts as a whole only,
has its own masks: cut into two blocks more than the substitutions it may have, it keeps two blocks whole.

The benchmark is broadcast in blocks of bounded size, each against all documents, in a map without a shuffle.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, mix, tidied, words_of

MASKS = ("1110111", "110100000111", "101011011")
#: An overlap has at least so many words (or all words of a shorter test) of which this share, in percent, is equal.
LEAST_WORDS, LEAST_PERCENT = 13, 80
#: Bytes of benchmark text in a block, the bound of one broadcast; words of documents seeded at a time.
BLOCK_BYTES = 16 << 20
_BATCH_WORDS = 300_000
#: Alignments, and words compared, at a time.
_HITS, _COMPARED = 1 << 18, 1 << 21
_PUNCTUATION = string.punctuation.encode()
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(64)]


class _Hash(WordHash):
    """Words without ASCII punctuation at their ends (unless nothing else is left)."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_PUNCTUATION) or word
        if bare == word:
            return super().__missing__(word)
        h = self[bare]
        self[word] = h
        return h


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The seed at each position where the mask fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out += h[i : i + n] * _STEP[i]
    return mix(out)


def short_masks(n: int) -> list[str]:
    """Masks of a test of ``n`` words, fewer than LEAST_WORDS: one fits whenever LEAST_PERCENT of them are equal."""
    changed = n * (100 - LEAST_PERCENT) // 100
    if not changed:
        return ["1" * n]
    cut = [n * i // (changed + 2) for i in range(changed + 3)]
    kept = itertools.combinations(range(changed + 2), 2)
    return ["".join("1" if any(cut[b] <= i < cut[b + 1] for b in two) else "0" for i in range(n)) for two in kept]


def longest_run(same: np.ndarray, percent: int) -> tuple[int, int]:
    """Start and length of the longest run with at least ``percent`` of its entries true (the first of equal ones)."""
    gain = np.where(same, 100 - percent, -percent).astype(np.int64)
    total = np.r_[0, np.cumsum(gain)]
    low: list[int] = []
    for i, v in enumerate(total):
        if not low or v < total[low[-1]]:
            low.append(i)
    best, at, k = 0, 0, len(low) - 1
    for j in range(len(total) - 1, -1, -1):
        while k >= 0 and total[low[k]] <= total[j]:
            if j - low[k] >= best and j > low[k]:
                if j - low[k] > best or low[k] < at:
                    best, at = j - low[k], low[k]
            k -= 1
    return at, best


class Index:
    """The seeds of a block of tests."""

    def __init__(self, items: list[tuple[object, str]]):
        hash_ = _Hash()
        self.ids = [i for i, _ in items]
        self.words = [hash_.array(words_of(t)) for _, t in items]
        self.lens = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        self.begin = np.cumsum(self.lens) - self.lens
        self.least = np.maximum(1, -(-np.minimum(self.lens, LEAST_WORDS) * LEAST_PERCENT // 100))
        short = sorted({len(w) for w in self.words if 0 < len(w) < LEAST_WORDS})
        masks = [(m, None) for m in MASKS] + [(m, n) for n in short for m in short_masks(n)]
        self.tables = []
        for k, (mask, size) in enumerate(masks):
            key, item, at = [], [], []
            for n, w in enumerate(self.words):
                if len(w) >= LEAST_WORDS if size is None else len(w) == size:  # shorter tests are sought as a whole
                    s = seeds(w, mask, k)
                    key.append(s), item.append(np.full(len(s), n, np.int32)), at.append(np.arange(len(s), dtype=np.int32))
            key = np.concatenate(key) if key else np.zeros(0, np.uint64)
            order = np.argsort(key, kind="stable")
            item = np.concatenate(item)[order] if item else np.zeros(0, np.int32)
            at = np.concatenate(at)[order] if at else np.zeros(0, np.int32)
            bits = max(16, int(np.ceil(np.log2(len(key) + 1))) + 3)
            seen = np.zeros(1 << bits, bool)
            seen[key[...] >> np.uint64(64 - bits)] = True
            self.tables.append((mask, k, key[order], item, at, seen, np.uint64(64 - bits)))

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, test, position in the test) of equal seeds, some at a time."""
        for mask, salt, key, item, at, seen, shift in self.tables:
            s = seeds(h, mask, salt) if len(key) else key
            spots = np.flatnonzero(seen[s >> shift])
            if not len(spots):
                continue
            a, b = np.searchsorted(key, s[spots], "left"), np.searchsorted(key, s[spots], "right")
            ends = np.cumsum(b - a)
            for low in range(0, int(ends[-1]), _HITS):
                n = np.arange(low, min(low + _HITS, int(ends[-1])))
                spot = np.searchsorted(ends, n, "right")
                k = b[spot] - ends[spot] + n
                yield spots[spot], item[k].astype(np.int64), at[k].astype(np.int64)

    def _equal(self, h: np.ndarray, n: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many words of test ``n`` at ``d`` are equal, in [low, high) of ``h``, for arrays of alignments."""
        out = np.zeros(len(n), np.int64)
        step = np.cumsum(high - low)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(step, (step[i - 1] if i else 0) + _COMPARED, "right")))
            size = high[i:j] - low[i:j]
            before = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(before, size)
            here = np.repeat(low[i:j], size) + within
            same = h[here] == self.flat[here + np.repeat(self.begin[n[i:j]] - d[i:j], size)]
            out[i:j] = np.add.reduceat(same, before, dtype=np.int64)
            i = j
        return out

    def overlaps(self, h: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(document, test, start, start in the test, words, equal words) of verified overlaps, for documents one after another
        in ``h`` that begin at ``starts`` (with the end of the last)."""
        found = []
        for p, item, at in self.hits(h):
            x = np.unique(np.stack([item, p - at, np.searchsorted(starts, p, "right") - 1], 1), axis=0)
            n, d, doc = x.T
            low, high = np.maximum(d, starts[doc]), np.minimum(d + self.lens[n], starts[doc + 1])
            # too few words for the rule even if all others were in the run
            room = high - low >= np.minimum(self.lens[n], LEAST_WORDS)
            x, n, d, low, high = x[room], n[room], d[room], low[room], high[room]
            x = x[self._equal(h, n, d, low, high) >= self.least[n]]
            if len(x):
                found.append(x)
        out = []
        if not found:
            return out
        for n, d, doc in np.unique(np.concatenate(found), axis=0):
            w = self.words[n]
            a, b = max(int(d), int(starts[doc])), min(int(d) + len(w), int(starts[doc + 1]))
            same = h[a:b] == w[a - d : b - d]
            at, size = longest_run(same, LEAST_PERCENT)
            if size >= min(LEAST_WORDS, len(w)) and size:
                out.append((int(doc), int(n), a + at - int(starts[doc]), a + at - int(d), size, int(same[at : at + size].sum())))
        return out


def _scan(texts: list[str | None], index: Index, hash_: _Hash) -> list[tuple[int, int, int, int, int, int]]:
    out, held, first, n = [], [], 0, 0

    def flush(first: int) -> None:
        starts = np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int64)
        out.extend((d + first, *rest) for d, *rest in index.overlaps(np.concatenate(held), starts))

    for i, t in enumerate(texts):
        held.append(hash_.array(words_of(t)))
        n += len(held[-1])
        if n >= _BATCH_WORDS:
            flush(first)
            held, first, n = [], i + 1, 0
    if held:
        flush(first)
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The tests in blocks of about ``limit`` bytes; null and empty texts are no tests."""
    tests = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.length("t") > 0)
    total = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    for k in range(n):
        part = tests.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k) if n > 1 else tests
        yield [(r.i, r.t) for r in part.orderBy("i", "t").collect()]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row a verified overlap: id, item_id, start, item_start (in words), n_words, n_equal.

    Documents without an overlap have no row. Whole texts are searched; null and empty texts have no words, null and empty tests are
    none. Rows with equal or null ids each give their own rows, equal tests each theirs; of equally long runs along an alignment the first
    counts. Other columns, whatever they are called, are not read; an empty table on either side gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([docs.schema[id_col], T.StructField(item_col, item_type), *T.StructType.fromDDL("start int, item_start int, n_words int, n_equal int")])
    out = None
    for block in blocks(benchmark, item_col):
        part = rows.mapInArrow(tidied(_overlap_rows(spark.sparkContext.broadcast(block), schema)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _overlap_rows(sent, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        index, hash_ = Index(sent.value), _Hash()
        for batch in batches:
            got = _scan(batch.column(1).to_pylist(), index, hash_)
            ids = batch.column(0).take(pa.array([g[0] for g in got], pa.int64()))
            cols = [pa.array([index.ids[g[1]] for g in got], kinds.field(1).type)]
            cols += [pa.array([g[i] for g in got], pa.int32()) for i in range(2, 6)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=schema.names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents without a verified overlap with any test, all columns as they were, whatever they are called; a map without a
    shuffle. Null and empty texts stay; whole texts are searched; repeated rows are treated alike, and one overlap is enough where several tie; without tests all rows stay, and an empty table
    stays empty."""
    schema = docs.schema
    at = docs.columns.index(text_col)
    out = docs
    for block in blocks(benchmark, item_col):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, hash_ = Index(sent.value), _Hash()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[g[0] for g in _scan(batch.column(at).to_pylist(), index, hash_)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(tidied(run), schema)
    return out
