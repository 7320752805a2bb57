"""Shared helpers: scratch tables on the cluster's shared folder, packed Arrow columns, bounded broadcasts.

Nothing here uses a machine-local folder on a cluster: scratch tables go to the folder named by
``spark.checkpoint.dir``; only a session that names none (as in tests) gets a folder of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tesselar.plans.scratch import opened

_OWN: dict[str, str] = {}
#: Roots of scratch tables that were not swept.
_MADE: list[str] = []
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
FOLD = str.maketrans(UPPER, LOWER)
#: The characters of [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tesselar-")
    return _OWN[app]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 500 rows or 4 MB, and Parquet batches of 512 rows, unless the session has settings of its own: texts are
    long, and a task holds a batch several times over (in the JVM, where the bytes of a column are one array, on the way, in Python)."""
    for key, default, ours in (("execution.arrow.maxRecordsPerBatch", "10000", "500"), ("execution.arrow.maxBytesPerBatch", None, "4m"), ("parquet.columnarReaderBatchSize", "4096", "512")):
        key = f"spark.sql.{key}"
        if spark.conf.get(key, default) == default or default is None and not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, ours)


class Scratch:
    """Tables written once and read again: they cut the lineage, survive lost executors and can be dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _MADE.append(self.root)
        self.n = 0
        small_batches(spark)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{name}{self.n}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that nothing will read again."""
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                delete(self.spark, path)


def sweep(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Removes the scratch folders made after the first ``since`` ones, whose tables nothing will read again, but for ``keep``."""
    for root in [r for r in _MADE[since:] if r != keep]:
        delete(spark, root)
        _MADE.remove(root)


def made() -> int:
    return len(_MADE)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


#: Rows of a block, as a power of two, and the blocks that the numbers of a partition of the scan may fill: most have rows in the first only.
BLOCK_ROWS = 17
PARTITION_BLOCKS = 33 - BLOCK_ROWS
#: Bytes of a batch of rows that met facts.
_MEET_BYTES = 4 << 20


class Numbered:
    """Rows written once, each with a number, so that what was found about a row meets it again where it lies.

    Numbers are read from the written table and never drawn twice, whatever the scan's splits are. The rows of a block lie side by side;
    facts about rows are sorted by block and written beside the table, and the task that reads a block reads its facts. So only facts
    are shuffled, never the rows.
    """

    def __init__(self, df: DataFrame, scratch: Scratch, name: str = "rows"):
        self.scratch, self.columns, self.row = scratch, df.columns, free_name(df, "_row")
        self.rows = scratch.save(df.withColumn(self.row, F.monotonically_increasing_id()), name)

    def block(self) -> Column:
        return F.shiftright(F.col(self.row), BLOCK_ROWS)

    def facts(self, found: DataFrame, block: Column) -> Facts:
        """Writes ``found`` by block; the result can be sent to tasks."""
        n, path = max(1, partitions(found.sparkSession) // 4), self.scratch.path("facts")
        dealt = found.select(block.alias("_block"), *found.columns)
        dealt = dealt.withColumn("part", F.pmod(F.col("_block") + F.shiftright("_block", PARTITION_BLOCKS), F.lit(n)))
        dealt = dealt.repartition("part").sortWithinPartitions("part", "_block")
        dealt.write.option("parquet.block.size", 1 << 20).partitionBy("part").parquet(path)
        return Facts(path, n, found.columns)

    def meet(self, table: DataFrame, found: DataFrame, on: str) -> DataFrame:
        """``table`` joined with ``found`` by the row number ``on``, for tables whose rows lie as the numbered ones do: written by a map over them, or
        over such a table. A map over ``table``; what it holds beside the number isn't shuffled, however large ``found`` is."""
        facts, at = self.facts(found, F.shiftright(on, BLOCK_ROWS)), table.columns.index(on)
        rest = [c for c in found.columns if c != on]
        schema = T.StructType([*table.schema.fields, *(found.schema[c] for c in rest)])
        target = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for part, rows, known in facts.beside(batches, at):
                if not known.num_rows:
                    continue
                if last is None or last[0] is not known:
                    keys = known.column(on).to_numpy()
                    by = np.argsort(keys, kind="stable")
                    last = known, keys[by], by
                _, keys, by = last
                first = np.searchsorted(keys, rows, "left")
                count = np.searchsorted(keys, rows, "right") - first
                if not count.any():
                    continue
                ends = np.cumsum(count)
                mine = np.repeat(np.arange(len(rows)), count)
                theirs = by[np.arange(ends[-1]) + np.repeat(first - ends + count, count)]
                weight = np.zeros(len(rows), np.int64)
                for column in part.columns:
                    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                        weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
                begin = np.cumsum(weight[mine]) // _MEET_BYTES
                cuts = [0, *(np.flatnonzero(np.diff(begin)) + 1).tolist(), len(mine)]
                for a, b in zip(cuts, cuts[1:]):
                    left, right = part.take(pa.array(mine[a:b])), known.take(pa.array(theirs[a:b])).combine_chunks()
                    columns = [*left.columns, *(pa.concat_arrays(right.column(c).chunks) for c in rest)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

        return table.mapInArrow(tidied(run), schema)

    def without(self, dropped: DataFrame) -> DataFrame:
        """The rows, as they were, but for those whose number is in the one column of ``dropped``."""
        name = dropped.columns[0]
        facts = self.facts(dropped, F.shiftright(F.col(name), BLOCK_ROWS))
        at = self.rows.columns.index(self.row)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows, known in facts.beside(batches, at):
                yield part.filter(pa.array(~np.isin(rows, known.column(0).to_numpy())))

        return self.rows.mapInArrow(tidied(run), self.rows.schema).drop(self.row)


class Facts:
    """What is known about the rows of each block, read by the task that has the block."""

    def __init__(self, path: str, n: int, columns: list[str]):
        self.path, self.n, self.columns, self.last = path, n, columns, None

    def of(self, block: int) -> pa.Table:
        if self.last is None or self.last[0] != block:
            self.last = block, self._read(block)
        return self.last[1]

    def _read(self, block: int) -> pa.Table:
        from pyarrow import fs
        from pyarrow import parquet as pq

        files, path = opened(f"{self.path}/part={(block + (block >> PARTITION_BLOCKS)) % self.n}")
        found = []
        for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with files.open_input_file(info.path) as source, pq.ParquetFile(source) as f:
                    at = f.schema_arrow.get_field_index("_block")
                    for k in range(f.num_row_groups):
                        stats = f.metadata.row_group(k).column(at).statistics  # no list comes before the block in the schema
                        if stats is None or stats.min <= block <= stats.max:
                            rows = f.read_row_group(k, columns=["_block", *self.columns], use_threads=False)
                            found.append(rows.filter(pa.array(rows.column("_block").to_numpy() == block)).select(self.columns))
        return pa.concat_tables(found).combine_chunks() if found else pa.table({c: pa.array([], pa.int64()) for c in self.columns})

    def beside(self, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Table]]:
        """Parts of batches that lie in one block, the numbers of their rows (column ``at``), and the block's facts."""
        for batch, rows in by_block(batches, at):
            yield batch, rows, self.of(int(rows[0]) >> BLOCK_ROWS)


def tidied(run):
    """``run`` over batches; after the last one the worker, which other tasks and stages will use, hands free memory back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidy


def by_block(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        rows = batch.column(at).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(rows >> BLOCK_ROWS)) + 1).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a), rows[a:b]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def fold_of_id(col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def list_of(values: np.ndarray, lengths, kind=pa.int64()) -> pa.ListArray:
    """A list column from one flat array and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the public splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHash(dict):
    """Word (as UTF-8) -> signed 64-bit hash, kept for words seen before, up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        h = self[word] = h - (1 << 64) if h >> 63 else h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than [\\x20\\x09-\\x0D], with A-Z lower-cased, as UTF-8.

    Bytes know only ASCII white space and letters, and no part of a longer character is one of them."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Odd multipliers, one a position in a shingle.
_STEPS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(64)], np.uint64)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out += hashes[i : n - size + 1 + i] * _STEPS[i]
    return mix(out + np.uint64(size))
