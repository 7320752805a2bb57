"""Line deduplication with two Bloom filters.

Texts are written once in blocks. A pass over them gives, for each block, the distinct hashes of its line keys; these hashes, and
nothing else, are dealt by hash. Each task then owns a slice of two filters: a hash sets its bits in the once-seen filter, and those of a
hash that was there already in the twice-seen filter. The task answers which hashes of which block the twice-seen filter holds. A block's
answers are read beside its texts: lines that they hold are suspected repeats, and only they are shuffled, as whole keys, to confirm the
repeat exactly and to find the first document that holds them. What a block loses is again read beside its texts.

So texts are read three times and never shuffled, whatever their number; a frequent line is sent once a block; no filter is broadcast, and
the filters grow with the number of slices. False positives cost a shuffled line and never change the result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_ROWS, Numbered, Scratch, by_block, mix, partitions, tidied

#: Bits of a filter for each hash that a slice gets, and probes; bytes of text whose hashes make a slice.
BITS_A_HASH = 16
PROBES = 4
SLICE_BYTES = 32 << 20
#: Hashes gathered before they are made distinct; hashes set at a time.
_FLUSH, _CHUNK = 400_000, 1 << 16
_NO_ID = (1 << 63) - 1


def keys_of(text: bytes, least: int) -> list[bytes]:
    """The key of each line, empty if it has fewer than ``least`` code points.

    Lower-casing and stripping bytes touches ASCII letters and [\\x20\\x09-\\x0D] only."""
    out = [x.strip() for x in text.lower().split(b"\n")]
    return [k if len(k) >= least and (len(k) >= 4 * least or k.isascii() or len(k.decode("utf-8", "replace")) >= least) else b"" for k in out]


def hashes_of(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class Bloom:
    """A filter for about ``n`` hashes."""

    def __init__(self, n: int, bits: int = BITS_A_HASH):
        self.size = np.uint64(max(64, n * bits))
        self.bits = np.zeros(int(self.size) // 8 + 1, np.uint8)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        other = mix(h) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * other) % self.size for k in range(PROBES)])

    def add(self, h: np.ndarray) -> None:
        slots = self._slots(h).ravel()
        np.bitwise_or.at(self.bits, slots >> np.uint64(3), np.left_shift(1, slots & np.uint64(7)).astype(np.uint8))

    def holds(self, h: np.ndarray) -> np.ndarray:
        slots = self._slots(h)
        return (self.bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


def suspected(h: np.ndarray, again: np.ndarray, bits: int = BITS_A_HASH) -> np.ndarray:
    """Which of the hashes, distinct in their block, were seen twice: in another block, or ``again`` in their own."""
    once, twice = Bloom(len(h), bits), Bloom(len(h), bits)
    for at in range(0, len(h), _CHUNK):
        part, index, counts = np.unique(h[at : at + _CHUNK], return_inverse=True, return_counts=True)
        more = np.zeros(len(part), bool)
        more[index[again[at : at + _CHUNK]]] = True
        twice.add(part[more | (counts > 1) | once.holds(part)])
        once.add(part)
    return np.concatenate([np.zeros(0, bool), *(twice.holds(h[at : at + _CHUNK]) for at in range(0, len(h), _CHUNK))])


def _block_hashes(rows: DataFrame, least: int) -> DataFrame:
    """(h, block, again): the distinct hashes of line keys of a block, and whether two of its rows hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, None

        def out() -> pa.RecordBatch:
            h, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), block, np.int64)), pa.array(counts > 1)], names=["h", "block", "again"])

        for batch, numbers in by_block(batches, 0):
            mine = int(numbers[0]) >> BLOCK_ROWS
            if held and (mine != block or size > _FLUSH):
                yield out()
                held, size = [], 0
            block = mine
            for t in batch.column(1).to_pylist():
                keys = set(keys_of(t, least))
                keys.discard(b"")
                held.append(hashes_of(list(keys)))
                size += len(keys)
        if held:
            yield out()

    return rows.mapInArrow(tidied(run), "h long, block long, again boolean")


def _ask(hashes: DataFrame, bits: int) -> DataFrame:
    """(block, h): the hashes that the twice-seen filter of their slice holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches]
        if held:
            h, block, again = (np.concatenate([x[i] for x in held]) for i in range(3))
            hit = suspected(h.view(np.uint64), again, bits)
            yield pa.RecordBatch.from_arrays([pa.array(block[hit]), pa.array(h[hit])], names=["block", "h"])

    return hashes.mapInArrow(tidied(run), "block long, h long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, bits: int = BITS_A_HASH) -> DataFrame:
    """One row a document: id, n_lines, n_dropped, kept_text.

    A key is a line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased. Keys of at least ``least`` code points
    that two documents hold lose their lines everywhere but in the document with the smallest id. Null and empty texts are
    one empty line; long texts are read whole. Rows with the same id are one document; rows with a null id are one document after all others.
    Ids that aren't integers are compared as text. Other columns, whatever they are called, aren't read; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    kind = docs.schema[id_col].dataType
    if isinstance(kind, T.IntegralType):
        d = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    else:
        d = F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    numbered = Numbered(docs.select(F.col(id_col).alias("doc"), d.alias("d"), text.alias("text")), scratch)
    rows = numbered.rows.select(F.col(numbered.row).alias("row"), "text", "d", "doc")

    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(partitions(spark), -(-total // SLICE_BYTES))
    answers = numbered.facts(_ask(_block_hashes(rows.select("row", "text"), least).repartition(slices, "h"), bits), F.col("block"))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch, numbers, found in answers.beside(batches, 0):
            if known is None or known[0] is not found:
                known = found, np.sort(found.column("h").to_numpy().view(np.uint64))
            out = []
            if len(known[1]):
                lines = [keys_of(t, least) for t in batch.column(1).to_pylist()]
                h = hashes_of([k for ks in lines for k in ks])
                hit = known[1][np.minimum(np.searchsorted(known[1], h), len(known[1]) - 1)] == h
                ends = np.cumsum([len(ks) for ks in lines])
                mine: dict[tuple[int, bytes], list[int]] = defaultdict(list)
                for k in np.flatnonzero(hit).tolist():
                    n = int(np.searchsorted(ends, k, "right"))
                    at = k - int(ends[n]) + len(lines[n])
                    if lines[n][at]:
                        mine[n, lines[n][at]].append(at)
                out = [(n, key, at) for (n, key), at in mine.items()]
            of = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[1] for x in out], pa.binary()), batch.column(2).take(of), batch.column(0).take(of), pa.array([x[2] for x in out], pa.list_(pa.int32()))],
                names=["key", "d", "row", "at"],
            )

    schema = T.StructType([T.StructField("key", T.BinaryType()), rows.schema["d"], *T.StructType.fromDDL("row long, at array<int>")])
    found = scratch.save(rows.select("row", "text", "d").mapInArrow(tidied(suspects), schema), "suspects")
    repeated = found.groupBy("key").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("key", "first")
    repeated = scratch.save(repeated, "repeated")  # so that the join with a frequent line can be split
    lost = found.join(repeated, "key").where("d > first").select("row", "at")
    losses = numbered.facts(lost, F.shiftright("row", BLOCK_ROWS))
    scratch.drop(found, repeated)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drops, of = {}, None
        for batch, numbers, lost in losses.beside(batches, 0):
            if of is not lost:
                drops, of = defaultdict(set), lost
                for row, at in zip(lost.column("row").to_pylist(), lost.column("at").to_pylist()):
                    drops[row].update(at)
            n, gone, kept = [], [], []
            for row, t in zip(numbers.tolist(), batch.column(1).to_pylist()):
                drop = drops.get(row, ())
                n.append(t.count(b"\n") + 1), gone.append(len(drop))
                kept.append(b"\n".join([x for i, x in enumerate(t.split(b"\n")) if i not in drop]) if drop else t)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], names=[id_col, "n_lines", "n_dropped", "kept_text"])

    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL("n_lines long, n_dropped long, kept_text string")])
    return rows.select("row", "text", "doc").mapInArrow(tidied(apply), schema)
