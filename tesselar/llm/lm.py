"""Language-model scoring with Brown class-based bigrams.

All words are counted over the training rows. Words are in classes: the most frequent ones (CORE) by exchange clustering over
their bigram counts, where each word in turn moves to the class that raises the likelihood most; all others seen LEAST_HEAD
times by one exchange step each, against the clustered ones; the tail, which is seen too seldom for that, by its last letters. The
probability of a text is the product of class transitions, smoothed towards the class frequencies, and of word emissions. Tail
classes keep the mass of one more word of count 0 for all unseen words, so that the probabilities sum to 1.

The HEAD most frequent words and their classes are broadcast. All other words are not: their contexts are shuffled by word to
choose classes, and their tokens to the counts and classes. HEAD decides where a word is looked up, never its class.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, tidied, words_of

#: Words clustered by exchange, words broadcast, classes of words seen LEAST_HEAD times, classes of tail words.
CORE, HEAD, CLASSES, TAILS = 1000, 200_000, 48, 16
ROUNDS = 8
#: Words seen less often are tail words: too few contexts to choose a class by, and what new words will be like.
LEAST_HEAD = 5
#: Weight of the class frequencies in a transition, in tokens.
SMOOTH = 5.0
_FLUSH = 400_000
_END = CLASSES + TAILS


def tail_class(word: bytes) -> int:
    """A class by the last two bytes of a word."""
    return zlib.crc32(word[-2:]) % TAILS


class _Tails(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[word] = CLASSES + tail_class(word)
        return k


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(words_of(t))
                if len(held) > _FLUSH:
                    yield _pair(held)
                    held.clear()
        if held:
            yield _pair(held)

    def _pair(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    return texts.mapInArrow(tidied(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(texts: DataFrame, head, keys) -> DataFrame:
    """(key, n): how often ``keys(ids)`` gives each key, over the sequences of head ids (-1: tail) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = head.value, [], 0

        def out():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                held.append(keys(words, np.fromiter(map(ids.get, words, repeat(-1)), np.int64, len(words))))
                size += len(held[-1])
                if size > 4_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(tidied(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each word: exchange clustering that maximises the likelihood of class bigrams (ties: the lowest class).

    Starts with the words dealt in order; stops after ``rounds`` or when no word moves.
    """
    n = len(bigrams)
    of = np.arange(n) % classes
    hot = np.zeros((n, classes))
    hot[np.arange(n), of] = 1
    big = bigrams.astype(float)
    table = hot.T @ big @ hot
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            right, left, own = big[w] @ hot, big[:, w] @ hot, big[w, w]
            a = of[w]
            right[a] -= own
            left[a] -= own
            if not right.any() and not left.any() and not own:
                continue
            table[a, :] -= right
            table[:, a] -= left
            table[a, a] -= own
            hot[w, a] = 0
            # gain of each class: its row and column with and without the word, and the marginal terms
            row, col = table + right[None, :], table + left[:, None]
            gain = (_xlogx(row) - _xlogx(table)).sum(1) + (_xlogx(col) - _xlogx(table)).sum(0)
            d = np.diag(table)
            gain += _xlogx(d + right + left + own) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            out, into = table.sum(1) + left, table.sum(0) + right  # what all classes get of the word's neighbours in any case
            gain -= _xlogx(out + right.sum() + own) - _xlogx(out) + _xlogx(into + left.sum() + own) - _xlogx(into)
            b = int(np.argmax(gain))
            table[b, :] += right
            table[:, b] += left
            table[b, b] += own
            hot[w, b] = 1
            moved += b != a
            of[w] = b
        if not moved:
            break
    return of


class Model:
    """What the last step of scoring needs on every executor, of bounded size."""

    def __init__(self, transitions: np.ndarray, tail_words: np.ndarray):
        per_class = transitions.sum(0).astype(float)
        share = (per_class + 0.5) / (per_class.sum() + 0.5 * len(per_class))
        out = transitions.sum(1, keepdims=True).astype(float)
        self.step = np.log10((transitions + SMOOTH * share[None, :]) / (out + SMOOTH))
        self.rest = -np.log10(np.r_[np.maximum(per_class[:CLASSES], 1), per_class[CLASSES:_END] + 0.5 * (tail_words + 1)])


class Words:
    """All words of the training rows: the head, to be broadcast, and the table of all others."""

    def __init__(self, head: dict[bytes, int], counts: np.ndarray, of: np.ndarray, others: DataFrame, tail_words: np.ndarray, total: int, types: int, ends: int):
        self.head, self.counts, self.of, self.others, self.tail_words = head, counts, of, others, tail_words
        self.total, self.ends = total, ends
        self.base_rest = -math.log10(total + 0.5 * (types + 1))


def _rare_contexts(texts: DataFrame, sent, core_of: np.ndarray) -> DataFrame:
    """(word, side and class of a core neighbour, n) of the words that are not in the head; each task counts before the shuffle."""
    core = len(core_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = sent.value, Counter()

        def out():
            words, at = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(at, pa.int32()), pa.array(list(held.values()), pa.int64())], names=["word", "at", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                ids = np.fromiter(map(head.get, words, repeat(-1)), np.int64, len(words))
                a, b = ids[:-1], ids[1:]
                right, left = np.flatnonzero((a < 0) & (b >= 0) & (b < core)), np.flatnonzero((b < 0) & (a >= 0) & (a < core))
                held.update(zip(map(words.__getitem__, right.tolist()), core_of[b[right]].tolist()))
                held.update(zip(map(words.__getitem__, (left + 1).tolist()), (CLASSES + core_of[a[left]]).tolist()))
                if len(held) > _FLUSH:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.mapInArrow(tidied(run), "word binary, at int, n long")


def _choose(contexts: DataFrame, weight: np.ndarray) -> DataFrame:
    """(word, k): the class with the largest gain, from contexts sorted by word within partitions that hold all of a word's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words, seen):
            return pa.RecordBatch.from_arrays([words, pa.array(np.argmax(seen @ weight, 1), pa.int32())], names=["word", "k"])

        last, kept = None, None  # the last word may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy()
            seen = np.bincount(code.astype(np.int64) * 2 * CLASSES + batch.column(1).to_numpy(), batch.column(2).to_numpy(), len(words) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            if last is not None:
                if words[0].as_py() == last:
                    seen[0] += kept
                else:
                    yield out(pa.array([last], pa.binary()), kept[None])
            if len(words) > 1:
                yield out(words[:-1], seen[:-1])
            last, kept = words[-1].as_py(), seen[-1]
        if last is not None:
            yield out(pa.array([last], pa.binary()), kept[None])

    return contexts.mapInArrow(tidied(run), "word binary, k int")


def train(texts: DataFrame, scratch: Scratch) -> Words:
    """Counts and classes of all words of a DataFrame with the one column ``text``."""
    spark = texts.sparkSession
    sc = spark.sparkContext
    counts = scratch.save(count_words(texts), "counts")
    ends = texts.count()
    sums = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, types = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    # the least count of a head word, from the numbers of words by count, in steps of an eighth: at most 8 * 63 rows
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    least, room, more = 1 << 62, HEAD, None
    for r in counts.where(F.col("c") >= LEAST_HEAD).groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect():
        if room < r.n:
            more = r.c
            break
        room -= r.n
        least = r.c
    top = sorted(((bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).collect()), key=lambda r: (-r[1], r[0]))
    others = F.col("c") < least
    short = min(CORE, HEAD) - len(top)
    if more and short > 0:  # a step that does not fit fills up the core
        top += [(bytes(r.word), r.c) for r in counts.where((F.col("c") >= more) & (F.col("c") < least)).orderBy(F.desc("c"), "word").limit(short).collect()]
        others = (F.col("c") < top[-1][1]) | ((F.col("c") == top[-1][1]) & (F.col("word") > F.lit(top[-1][0])))
    head = {w: i for i, (w, _) in enumerate(top)}
    n_head = len(top)
    n_of = np.array([c for _, c in top], float)

    core = min(CORE, n_head)
    sent = sc.broadcast({w: i for w, i in head.items() if i < core})

    def pairs(words, ids):
        a, b = ids[:-1], ids[1:]
        ok = (a >= 0) & (b >= 0)
        return a[ok] * core + b[ok]

    big = np.zeros((core, core))
    for r in _summed(texts, sent, pairs).toLocalIterator():
        big[r.key // core, r.key % core] = r.n
    of = np.zeros(n_head, np.int64)
    of[:core] = exchange(big, CLASSES)

    chosen = None
    if n_head > core or more:
        hot = np.zeros((core, CLASSES))
        hot[np.arange(core), of[:core]] = 1
        table = hot.T @ big @ hot + 0.1
        after, before = np.log(table / table.sum(1, keepdims=True)), np.log(table / table.sum(0, keepdims=True))
        weight = np.concatenate([after.T, before], 0)  # right neighbours' classes, then left ones, to the word's class
        core_of, sent_all = of[:core].copy(), sc.broadcast(head)
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if more:
            by_word = _rare_contexts(texts, sent_all, core_of).repartition(n_parts, "word").sortWithinPartitions("word")
            chosen = _choose(by_word, weight)

    if n_head > core:

        def contexts(words, ids):
            a, b = ids[:-1], ids[1:]
            right, left = (a >= core) & (b >= 0) & (b < core), (b >= core) & (a >= 0) & (a < core)
            return np.r_[a[right] * 2 * CLASSES + core_of[b[right]], b[left] * 2 * CLASSES + CLASSES + core_of[a[left]]]

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    w = k // (2 * CLASSES)
                    if w not in seen:
                        seen[w] = np.zeros(2 * CLASSES)
                    seen[w][k % (2 * CLASSES)] += n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([int(np.argmax(v @ weight)) for v in seen.values()], pa.int64())], names=["w", "k"])

        seen = _summed(texts, sent_all, contexts)
        by_word = seen.repartition(n_parts, F.floor(F.col("key") / (2 * CLASSES)))
        for r in by_word.mapInArrow(tidied(choose), "w long, k long").collect():  # a row a head word at most
            of[r.w] = r.k

    rest = counts.where(others)
    if chosen is not None:  # class 0, as in the head, without a core neighbour; null in the tail
        k = F.when(F.col("c") >= LEAST_HEAD, F.coalesce("k", F.lit(0)))
        rest = scratch.save(rest.join(chosen, "word", "left").select("word", "c", k.alias("k")), "others")
    else:
        rest = rest.withColumn("k", F.lit(None).cast("int"))
    tail = F.crc32(F.substring(F.col("word"), F.greatest(F.octet_length("word") - 1, F.lit(1)), F.lit(2))) % TAILS
    tail_words = np.zeros(TAILS)
    for r in rest.where("k is null").groupBy(tail.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect():
        tail_words[r.t] = r.n
    return Words(head, n_of, of, rest, tail_words, total, types, ends)


def sequence(words: list[bytes], head: dict[bytes, int], of: np.ndarray, tails: _Tails) -> tuple[np.ndarray, np.ndarray]:
    """Head ids (-1: tail) of the words; classes from the end before the text to the end after it."""
    ids = np.fromiter(map(head.get, words, repeat(-1)), np.int64, len(words))
    seq = np.full(len(words) + 2, _END, np.int64)
    if len(of):
        seq[1:-1] = of[ids]
    rare = np.flatnonzero(ids < 0)
    if len(rare):
        seq[rare + 1] = [tails[words[i]] for i in rare]
    return ids, seq


def score(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, the training flag, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null and empty texts are one end; long texts are scored whole. Without training rows nothing is known; then both scores come from
    the smoothing alone. A null flag is no training. Rows with equal or null ids each have their own row; an empty table gives none.
    Other columns, whatever they are called, are not read. Ties between classes go to the lowest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = train(rows.where("train").select("text"), scratch)
    sent = spark.sparkContext.broadcast((known.head, known.of, np.log10(known.counts), np.log10(known.counts + 0.5)))
    end_known, end_log, base_rest = known.total > 0, math.log10(known.ends + 0.5), known.base_rest
    schema = T.StructType([*T.StructType.fromDDL("row long, train boolean, n_tokens long, n_known long, base double, score double, seq binary, which binary, words array<binary>, times array<int>").fields, T.StructField("doc", docs.schema[id_col].dataType)])
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes as if all words beyond the head were of the tail and unseen, and these words."""
        (head, of, log, log_half), tails = sent.value, _Tails()
        for batch in batches:
            out = []
            for t in batch.column(3).to_pylist():
                words = words_of(t)
                ids, seq = sequence(words, head, of, tails)
                in_head = ids[ids >= 0]
                number: dict[bytes, int] = {}
                which = np.array([number.setdefault(words[i], len(number)) for i in np.flatnonzero(ids < 0).tolist()], np.int32)
                unseen = len(which) * math.log10(0.5)
                base = float(log_half[in_head].sum()) + end_log + unseen + (len(words) + 1) * base_rest
                out.append((len(words) + 1, len(in_head) + end_known, base, float(log[in_head].sum()) + unseen, seq.astype(np.uint8).tobytes(), which.tobytes(), list(number), np.bincount(which, minlength=len(number)).tolist()))
            cols = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols, batch.column(1)], names=schema.names)

    looked = scratch.save(rows.mapInArrow(tidied(look_up), schema), "looked")
    tokens = looked.select("row", F.posexplode(F.arrays_zip("words", "times")).alias("at", "x")).select("row", "at", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    half, unseen = F.log10(F.col("c") + 0.5), F.log10(F.lit(0.5))
    found = tokens.join(known.others, "word").groupBy("row").agg(
        F.sum(F.col("times") * (half - unseen)).alias("b"),
        F.sum(F.col("times") * (F.when(F.col("k").isNull(), half).otherwise(F.log10("c")) - unseen)).alias("v"),
        F.sum("times").alias("n"),
        F.collect_list(F.when(F.col("k").isNotNull(), F.col("at").cast("long") * CLASSES + F.col("k"))).alias("classed"),
    )
    more = scratch.save(found, "rare")
    joined = looked.drop("words", "times").join(more, "row", "left").select(
        "doc",
        "train",
        "n_tokens",
        (F.col("n_known") + F.coalesce("n", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base"),
        (F.col("score") + F.coalesce("v", F.lit(0.0))).alias("score"),
        "seq",
        "which",
        "classed",
    )
    names = [c for c in joined.columns if c not in ("which", "classed")]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chosen classes of words beyond the head put in their places."""
        for batch in batches:
            out = []
            for seq, which, classed in zip(*(batch.column(i).to_pylist() for i in (6, 7, 8))):
                if classed:
                    seq, which, c = np.frombuffer(seq, np.uint8).copy(), np.frombuffer(which, np.int32), np.array(classed, np.int64)
                    spots = np.flatnonzero((seq >= CLASSES) & (seq < _END))
                    k = np.full(int(which.max()) + 1, 255, np.uint8)
                    k[c // CLASSES] = c % CLASSES
                    new = k[which]
                    seq[spots] = np.where(new < 255, new, seq[spots])
                    seq = seq.tobytes()
                out.append(seq)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.binary())], names=names)

    filled = scratch.save(joined.mapInArrow(tidied(fill), joined.select(*names).schema), "filled")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _END + 1
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                seq = np.frombuffer(seq, np.uint8).astype(np.int64)
                np.add.at(table, seq[:-1] * size + seq[1:], 1)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(table[some], pa.int64())], names=["key", "n"])

    transitions = np.zeros((_END + 1, _END + 1))
    for r in filled.where("train").select("seq").mapInArrow(tidied(steps), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        transitions[r.key // (_END + 1), r.key % (_END + 1)] = r.n
    model = spark.sparkContext.broadcast(Model(transitions, known.tail_words))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = []
            for seq, s in zip(batch.column(6).to_pylist(), batch.column(5).to_pylist()):
                seq = np.frombuffer(seq, np.uint8)
                out.append(s + float(m.step[seq[:-1], seq[1:]].sum()) + float(m.rest[seq[1:-1]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.float64())], names=names[:6])

    return filled.mapInArrow(tidied(finish), filled.select(*names[:6]).schema).select(
        F.col("doc").alias(id_col),
        F.col("train").alias(train_col),
        "n_tokens",
        "n_known",
        F.lit(int(known.total)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
