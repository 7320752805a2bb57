"""Source divergence audit by sorted runs: how the wording of a language's sources differs, exactly.

1. Each task cuts its texts into terms and chains its own documents: an entry (lang, term, source) says in how many documents of the
   chain the term occurs and how often. So a frequent term is a few entries a task, not one a document.
2. Entries go to buckets by a hash of the term, those of a chain and bucket packed in one row, so that the shuffle moves and sorts few
   rows. A task takes bucket by bucket and adds up runs in the order of (lang, term, source): document frequency decides whether the
   language keeps the term, and counts go out by source.
3. Sums over all kept terms need no row for terms that are absent. With p0 a group's value for a count of 0, the sum of f(p, q) over all
   terms is that of the terms present in one group only (from a histogram of each group's values), of those in neither (a number times
   f(p0, q0)), and a correction for terms present in both. The scan over a term's run makes the corrections as partial pairs, added up in
   the task before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free_name, partitions, tidied

#: Least number of documents that hold a kept term; ranks of the part ``term``.
LEAST_DOCS = 3
TOP = 200
#: Entries that a task holds before it hands them on, partial pairs that a scan holds, and elements of its arrays.
_HELD = 600_000
_HELD_PAIRS = 200_000
_PAIRS = 1 << 20
#: Buckets of terms for each partition of the shuffle; a task holds one at a time. Rows that it hands on in a batch.
_BUCKETS = 2
_OUT = 1 << 16

#: Bytes of UTF-8: A-Z lower-cased, other ASCII characters than letters become blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _share(times: Column, n: Column) -> Column:
    """1 + floor(10^9 * (times + 1) / n), exact for any counts; 1 if nothing is kept."""
    wide = _div((times + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), n.cast("decimal(20,0)"))
    return F.when(n == 0, F.lit(1).cast("long")).otherwise(1 + F.when(times < 9_000_000_000, _div((times + 1) * F.lit(1_000_000_000), n)).otherwise(wide))


def buckets(spark: SparkSession) -> int:
    return _BUCKETS * partitions(spark)


def chains(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, text) as packed entries, a row for each chain and bucket of terms: how often terms occur in the documents of a chain.

    ``words`` holds the row's terms with a blank between them, ``docs`` and ``times`` their numbers as 64-bit integers; the first
    ``runs[0]`` terms are of ``langs[0]`` and ``sources[0]``, and so on."""
    n_buckets = np.uint64(buckets(docs.sparkSession))

    def pack(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        words = list(chain.from_iterable(times for times, _ in held.values()))
        n = len(words)
        found = np.fromiter(chain.from_iterable(map(found.__getitem__, times) for times, found in held.values()), np.int64, n)
        times = np.fromiter(chain.from_iterable(times.values() for times, _ in held.values()), np.int64, n)
        group = np.repeat(np.arange(len(held)), [len(times) for times, _ in held.values()])
        bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n) % n_buckets).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        bucket, group = bucket[by], group[by]
        new = np.diff(bucket, prepend=-1) != 0
        run = np.flatnonzero(new | (np.diff(group, prepend=-1) != 0))
        rows = np.r_[np.flatnonzero(new), n].astype(np.int32)
        offsets = pa.array(np.searchsorted(run, rows).astype(np.int32))
        names = [pa.ListArray.from_arrays(offsets, pa.array([k[i] for k in held], pa.string()).take(pa.array(group[run]))) for i in (0, 1)]
        runs = pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.r_[run, n]).astype(np.int32)))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(rows), pa.array(words, pa.binary()).take(pa.array(by))), pa.scalar(b" ", pa.binary()))
        numbers = [pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer(rows * np.int32(8)), pa.py_buffer(x[by])]) for x in (found, times)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[rows[:-1]]), *names, runs, joined, *numbers], names=["bucket", "langs", "sources", "runs", "words", "docs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if words := terms(text):
                    times, found = held.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(times)
                    times.update(words)
                    found.update(set(words))
                    size += len(times)
                    if size >= _HELD:
                        yield pack(held)
                        held.clear()
                        size = 0
        if held:
            yield pack(held)

    return docs.mapInArrow(tidied(run), "bucket int, langs array<string>, sources array<string>, runs array<int>, words binary, docs binary, times binary")


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Positions at which one of the columns changes; 0 is one."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in names:
        col = table.column(c).combine_chunks()
        if len(col) > 1:
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _by_term(rows: DataFrame, *order: str) -> DataFrame:
    """Rows sorted by (lang, term, ...), all of a term in one partition; a hash goes first as it is quick to compare."""
    h = free_name(rows, "_h")
    rows = rows.withColumn(h, F.xxhash64("lang", "term"))
    return rows.repartition(partitions(rows.sparkSession), h).sortWithinPartitions(h, "lang", "term", *order).drop(h)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of (lang, term) with their starts."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        starts = _starts(table, ["lang", "term"])
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts[:-1]
        rest = table.slice(int(starts[-1])) if len(starts) else None
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


def _entries(rows: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed rows: languages, terms and sources, each once; and the entries' keys, (lang, term, source) as one number, documents and times."""
    runs = np.concatenate([c.flatten().to_numpy() for c in rows.column("runs").chunks])
    flat = lambda c: pa.chunked_array([x.flatten() for x in rows.column(c).chunks]).combine_chunks().dictionary_encode()
    langs, sources = flat("langs"), flat("sources")
    words = pa.chunked_array([pc.split_pattern(x, pattern=" ").flatten() for x in rows.column("words").chunks]).combine_chunks().dictionary_encode()
    lang, source = (np.repeat(x.indices.to_numpy().astype(np.int64), runs) for x in (langs, sources))
    keys = (lang * len(words.dictionary) + words.indices.to_numpy()) * len(sources.dictionary) + source
    docs, times = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("docs", "times"))
    return langs.dictionary, words.dictionary, sources.dictionary, keys, docs, times


def kept_terms(packed: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, times, total, docs, first) of terms in at least ``least`` documents of the language: ``total`` occurrences
    and ``docs`` documents in the language; ``first`` is 1 once a term."""
    names = ["lang", "term", "source", "times", "total", "docs", "first"]

    def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, words, sources, keys, docs, times = _entries(rows)
        by = np.argsort(keys)
        keys = keys[by]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, docs, times = keys[starts], np.add.reduceat(docs[by], starts), np.add.reduceat(times[by], starts)
        term = keys // len(sources)
        new = np.diff(term, prepend=-1) != 0
        at = np.flatnonzero(new)
        lengths = np.diff(np.r_[at, len(term)])
        docs, total = (np.repeat(np.add.reduceat(x, at), lengths) for x in (docs, times))
        keep = np.flatnonzero(docs >= least)
        for a in range(0, len(keep), _OUT):
            k = keep[a : a + _OUT]
            cols = [langs.take(pa.array(term[k] // len(words))), words.take(pa.array(term[k] % len(words))), sources.take(pa.array(keys[k] % len(sources)))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x[k]) for x in (times, total, docs, new.astype(np.int64)))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and held[-1].column(0)[0].as_py() != bucket[a]:
                        yield from kept(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield from kept(pa.Table.from_batches(held))

    dealt = packed.repartitionById(partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidied(run), "lang string, term binary, source string, times long, total long, docs long, first long")


def _corrections(rows: DataFrame) -> DataFrame:
    """(g, h, value): partial sums, over terms present in both groups, of what the sums by single groups leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}

        def out() -> pa.RecordBatch:
            g, h = (pa.array([k[i] for k in sums], pa.int64()) for i in (0, 1))
            return pa.RecordBatch.from_arrays([g, h, pa.array(list(sums.values()), pa.int64())], names=["g", "h", "value"])

        def add(left: np.ndarray, right: np.ndarray, group: np.ndarray, p: np.ndarray, zero: np.ndarray) -> None:
            value = divergence(p[left], p[right]) - divergence(p[left], zero[right]) - divergence(zero[left], p[right]) + divergence(zero[left], zero[right])
            names, code = np.unique(group, return_inverse=True)
            pairs, at = np.unique(code[left] * len(names) + code[right], return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, value)
            for a, b, v in zip(names[pairs // len(names)].tolist(), names[pairs % len(names)].tolist(), total.tolist()):
                sums[a, b] = sums.get((a, b), 0) + v

        for table, starts in _runs(batches):
            group, p, zero = (table.column(c).to_numpy() for c in ("g", "p", "p0"))
            ends = np.r_[starts[1:], table.num_rows]
            lengths = ends - starts
            # pairs of a run: each row with all rows of its run; rows are taken in portions, whatever the run's length
            each, begin = np.repeat(lengths, lengths), np.repeat(starts, lengths)
            upto = np.cumsum(each)
            at = 0
            while at < len(each):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
                k = each[at:to]
                left = np.repeat(np.arange(at, to), k)
                right = np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[at:to], k)
                differ = left != right
                if differ.any():
                    low, high = int(begin[at]), int(right[-1]) + 1
                    add(left[differ] - low, right[differ] - low, group[low:high], p[low:high], zero[low:high])
                at = to
                if len(sums) > _HELD_PAIRS:
                    yield out()
                    sums.clear()
        yield out()

    return _by_term(rows.select("lang", "term", "g", "p", "p0"), "g").mapInArrow(tidied(run), "g long, h long, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) that occurs.

    A language keeps the terms in at least ``least`` of its documents; a document is a row, so repeated rows and equal ids count each.
    Group and language give a kept term p = 1 + floor(10^9 * (count + 1) / (N + V)), N being its occurrences of kept terms and V their
    number. Part ``pair`` has each other source of the language with the sum of f over all kept terms (0 without any), part ``term`` the
    terms of the group that it has more often than its language, up to rank ``top``. Ties go by the item's UTF-8. Null texts, languages and
    sources count as empty ones, texts without a term only make their group occur; long texts are read whole; an empty table gives an empty
    result. No other column is read, whatever it is called.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    kept = scratch.save(kept_terms(chains(rows), least), "kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("present"), F.sum("first").alias("first"))
    found = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "present", "first"])
    found = scratch.save(found.withColumn("g", F.monotonically_increasing_id()), "found")
    langs = found.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("first").alias("v"))
    groups = found.join(langs, "lang").select("lang", "source", "g", "present", "v", (F.col("n") + F.col("v")).alias("m"), (F.col("all") + F.col("v")).alias("m_lang"))
    groups = scratch.save(groups.withColumn("p0", _share(F.lit(0).cast("long"), F.col("m"))), "groups")

    values = kept.join(groups, ["lang", "source"]).select("lang", "term", "g", _share(F.col("times"), F.col("m")).alias("p"), _share(F.col("total"), F.col("m_lang")).alias("q"), "p0")
    values = scratch.save(values, "values")

    mine, other = groups.select("lang", "g", "p0", "present", "v"), groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"), F.col("present").alias("others"))
    bins = values.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("n")).join(mine.select("g", "p0"), "g")
    crossed = bins.join(other.select("lang", "h", "q0"), "lang").where("g <> h")
    crossed = crossed.groupBy("g", "h", "p0", "q0").agg(F.sum(F.col("n") * _divergence(F.col("p"), F.col("q0"))).alias("there"), F.sum(F.col("n") * _divergence(F.col("q0"), F.col("p"))).alias("back"))
    only = crossed.select("g", "h", F.col("there").alias("value")).unionByName(crossed.select(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value")))
    neither = mine.join(other, "lang").where("g <> h").select("g", "h", ((F.col("v") - F.col("present") - F.col("others")) * _divergence(F.col("p0"), F.col("q0"))).alias("value"))
    pairs = neither.unionByName(only).unionByName(_corrections(values)).groupBy("g", "h").agg(F.sum("value").alias("value"))
    names = groups.select(F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = pairs.join(names, "h").select("g", F.lit("pair").alias("part"), "item", "value")

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item")))
    more = values.where("p > q").select("g", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    out = ranked(pairs).unionByName(ranked(more).where(F.col("rank") <= top))
    return out.join(groups.select("g", "lang", "source"), "g").select("lang", "source", "part", "item", "value", "rank")
