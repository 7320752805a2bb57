"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. Blocks are sorted; equal neighbours get one integer
name. Then adjacent names of a document form pairs, which are sorted and named in the same way, until a document has one
name. Names are equal only if the texts are equal: no hash decides anything.

Sorting spreads a group of equal blocks over as many partitions as it needs (the row id is part of the range), so that no
group meets in one task. Each task names the runs it sees; runs that go on in the next partition are joined on the driver,
which gets the keys at the two ends of each partition and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbered, Scratch, fold, tidied

#: Bytes a block.
BLOCK = 4096
_LOCAL = 1 << 36


def _named(df: DataFrame, scratch: Scratch, prefix: list[str], keys: list[str], tie: str, carry: list[str]) -> DataFrame:
    """``carry`` columns and ``name``: equal for equal keys, different for different ones.

    ``prefix``: leading columns of the order, small enough to be sampled; equal keys have equal prefixes.
    """
    spark = df.sparkSession
    # small tables get few partitions, next to one another, so that names still rise
    rows = df.select(*dict.fromkeys([*prefix, *keys, tie, *carry]))
    rows = rows.repartitionByRange(*prefix, tie).sortWithinPartitions(*dict.fromkeys([*prefix, *keys, tie]))
    at = {c: i for i, c in enumerate(rows.columns)}
    pre, key, kept = [at[c] for c in prefix], [at[c] for c in keys], [at[c] for c in carry]
    end = T.StructType([T.StructField("head", T.BooleanType()), *[T.StructField(c, rows.schema[c].dataType) for c in dict.fromkeys([*prefix, *keys])], T.StructField("name", T.LongType())])
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in carry], T.StructField("name", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("ends", T.ArrayType(end))])
    names = list(dict.fromkeys([*prefix, *keys]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        local, last, first_prefix, head, tail, tail_prefix = -1, None, None, [], [], None
        kinds = [*[f.type for f in _arrow(schema)]]
        empty = None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out = []
            for p, k, full in zip(zip(*(cols[i] for i in pre)), zip(*(cols[i] for i in key)), zip(*(cols[at[c]] for c in names))):
                if (p, k) != last:
                    local += 1
                    last = (p, k)
                    end_row = dict(zip(names, full)) | {"name": part * _LOCAL + local}
                    if first_prefix is None:
                        first_prefix = p
                    if p == first_prefix:
                        head.append(end_row | {"head": True})
                    if p != tail_prefix:
                        tail, tail_prefix = [], p
                    tail.append(end_row | {"head": False})
                out.append(part * _LOCAL + local)
            empty = batch
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(out, pa.int64()), pa.array([part] * len(out), pa.int32()), pa.nulls(len(out), kinds[-1])],
                names=schema.names,
            )
        if empty is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kinds[i]) for i in range(len(kept))), pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([head + tail], kinds[-1])], names=schema.names)

    made = scratch.save(rows.mapInArrow(tidied(run), schema), "named")
    open_prefix, open_names, renamed = None, {}, []
    for row in made.where(F.col("ends").isNotNull()).select("part", "ends").orderBy("part").toLocalIterator():
        whole = {}
        for e in row.ends:
            p, k = tuple(e[c] for c in prefix), tuple(e[c] for c in keys)
            k = tuple(bytes(x) if isinstance(x, bytearray) else x for x in k)
            name = whole.get((p, k))
            if name is None:
                name = e["name"]
                if e["head"] and p == open_prefix and k in open_names:
                    name = open_names[k]
                    renamed.append((e["name"], name))
                whole[p, k] = name
        last = tuple(row.ends[-1][c] for c in prefix)
        tails = {k: v for (p, k), v in whole.items() if p == last}
        open_names = open_names | tails if last == open_prefix else tails
        open_prefix = last
    out = made.where(F.col("ends").isNull()).select(*carry, "name")
    out._scratch_path = made._scratch_path
    if renamed:  # at most a few runs a partition
        to = F.broadcast(spark.createDataFrame(renamed, "name long, to long"))
        path = made._scratch_path
        out = out.join(to, "name", "left").select(*carry, F.coalesce("to", "name").alias("name"))
        out._scratch_path = path
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """One row a document: row_id (or the given unique ``row_col``), the id, text_sha256 of the normalised text, and (level, name), equal for equal texts only.

    Null texts count as empty; only A-Z are lower-cased; long texts are many blocks. Rows with equal ids or null ids stay apart by row_id,
    repeated rows and ties share one name. An empty table gives an empty result. No other column is read, whatever it is called.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = docs.select(row.alias("row_id"), F.col(id_col).alias("doc"), fold(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary").alias("t"))
    count = F.greatest(F.ceil(F.octet_length("t") / F.lit(block)), F.lit(1)).cast("int")
    blocks = text.select("row_id", "doc", "t", F.sha2("t", 256).alias("sha"), F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"), count.alias("n"))
    first = F.col("pos") == 0
    blocks = blocks.select(
        "row_id",
        F.when(first, F.col("doc")).alias("doc"),
        F.when(first, F.col("sha")).alias("sha"),
        "pos",
        "n",
        F.substring("t", F.col("pos") * block + 1, F.lit(block)).alias("block"),
    ).withColumn("h", F.xxhash64("block"))
    carry = ["row_id", "doc", "sha", "pos", "n"]
    rows = _named(blocks, scratch, ["h"], ["block"], "row_id", carry)
    most = rows.agg(F.max("n")).first()[0] or 1
    done, level = [], 0
    while True:
        done.append(rows.where(F.col("n") == 1).select("row_id", "doc", "sha", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        pairs = (
            rows.where(F.col("n") > 1)
            .groupBy("row_id", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.max("doc").alias("doc"),
                F.max("sha").alias("sha"),
                F.ceil(F.max("n") / 2).cast("int").alias("n"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
            )
        )
        rows = _named(pairs, scratch, ["a", "b"], ["a", "b"], "row_id", carry)
        most, level = -(-most // 2), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("doc", id_col).withColumnRenamed("sha", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """One row a document: row_id, the id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays (null ids are the smallest; of equal ids the last row). An empty table
    gives an empty result. Long texts are many blocks, and no group of copies is collected anywhere.
    """
    scratch = Scratch(docs.sparkSession, "exact-groups")
    ids = scratch.save(identities(docs, id_col, text_col, block, row_col), "ids")
    groups = ids.groupBy("level", "name").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct(F.col(id_col).alias("doc"), "row_id")).alias("top"))
    groups = scratch.save(groups.where("size > 1"), "groups")
    return ids.join(groups, ["level", "name"], "left").select(
        "row_id",
        id_col,
        F.when(F.col("size").isNull(), F.col(id_col)).otherwise(F.col("top.doc")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("top.row_id") == F.col("row_id"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_dedup`` keeps, all columns as they were, whatever they are called.

    Of equal texts the row with the largest id stays; of several rows with this id one, as numbered when the rows were written. They
    are written once, so that the numbers hold if splits of the scan change; the result is a map over them. Null texts count as empty
    ones, null ids as the smallest; long texts are compared whole; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    rows = Numbered(docs, scratch)
    dropped = exact_dedup(rows.rows, id_col, text_col, row_col=rows.row).where("not kept").select("row_id")
    return rows.without(dropped)
