"""User kernels: functions over Arrow batches, from a callable, from source text or from a module, with bound tables and scalars."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Kernel:
    """``kernel(batch, args) -> batch`` run on every batch of the bound table.

    ``build`` takes a callable, source text that defines ``kernel`` or "module:function"; ``include`` ships helper files; ``bind`` sets
    the input, again if need be; ``args`` sets the scalars; ``dispatch`` runs on a number of partitions, ``dispatch_elements`` on as many
    as the rows need. Results are lazy; ``sync`` waits for them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._f, self._input, self._args = spark, None, None, {}

    def build(self, what: Callable | str) -> Kernel:
        if callable(what):
            self._f = what
        elif "\n" not in what and ":" in what and "(" not in what:
            module, _, name = what.partition(":")
            self._f = getattr(importlib.import_module(module), name)
        else:
            scope: dict = {}
            exec(compile(what, "<kernel>", "exec"), scope)
            if "kernel" not in scope:
                raise ValueError("the source defines no function named kernel")
            self._f = scope["kernel"]
        return self

    def include(self, path: str) -> Kernel:
        self.spark.sparkContext.addPyFile(path)
        return self

    def bind(self, table: DataFrame) -> Kernel:
        self._input = table
        return self

    def args(self, **scalars) -> Kernel:
        self._args = scalars
        return self

    def _run(self, table: DataFrame, schema) -> DataFrame:
        if self._f is None or self._input is None:
            raise ValueError("build and bind come before dispatch")
        f, args = self._f, dict(self._args)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield f(batch, args)

        return table.mapInArrow(run, schema)

    def dispatch(self, partitions: int, schema) -> DataFrame:
        return self._run(self._input.repartition(partitions) if self._input is not None else None, schema)

    def dispatch_elements(self, schema) -> DataFrame:
        return self._run(self._input, schema)

    @staticmethod
    def sync(df: DataFrame) -> int:
        return df.count()


def scaled(batch: pa.RecordBatch, args: dict) -> pa.RecordBatch:
    """A sample kernel: v * factor + shift."""
    import pyarrow.compute as pc

    return pa.RecordBatch.from_arrays([batch.column(0), pc.add(pc.multiply(batch.column(1), args["factor"]), args["shift"])], names=["idx", "w"])


def register_sql(spark: SparkSession) -> None:
    """The sample kernel as SQL function ``scale_add(v, factor, shift)``."""

    @F.pandas_udf("long")
    def scale_add(v: pd.Series, factor: pd.Series, shift: pd.Series) -> pd.Series:
        return v * factor + shift

    spark.udf.register("scale_add", scale_add)


def register_table_function(spark: SparkSession, name: str, kernel: Callable[[pa.Table, dict], pa.Table], schema: str, args: dict | None = None) -> None:
    """``SELECT * FROM name(TABLE(...) PARTITION BY ... ORDER BY ...)``: the kernel gets all rows of a partition in their order, and returns
    rows of the schema. A partition is held in one task; what need not be together is better a ``Kernel``, which goes by batches."""
    scalars = dict(args or {})

    class Run:
        def __init__(self):
            self.held = []

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            self.held.append(batch)
            yield from ()

        def terminate(self) -> Iterator[pa.Table]:
            if self.held:
                yield kernel(pa.Table.from_batches(self.held), scalars)

    spark.udtf.register(name, F.arrow_udtf(Run, returnType=schema))


def gaps(rows: pa.Table, args: dict) -> pa.Table:
    """A sample table kernel: each row with the difference from the row before, 0 for the first."""
    v = rows.column("v").to_numpy()
    return pa.table({"g": rows.column("g"), "idx": rows.column("idx"), "gap": pa.array(v - np.r_[v[:1], v[:-1]], pa.int64())})


#: Groups that a task holds before it sends what it has.
_GROUPS = 100_000
#: Tasks among which the partial results of one value are dealt.
SALTS = 64


def user_reduce(df: DataFrame, reduce: Callable[[pa.Table], pa.Table], schema: str, by: str) -> DataFrame:
    """A user reduction. ``reduce`` takes rows of the schema and returns fewer, one for each value of ``by``; it must be
    associative. Tasks reduce their rows; partial results of a value are dealt to SALTS tasks and reduced, and what these leave is shuffled
    by ``by`` and reduced once more, all by the same code, a batch at a time. So however many rows and tasks a value has, its last
    task gets no more than SALTS partial results, unless single tasks had too many groups to hold."""

    def run(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            names = batch.schema.names
            rows = pa.table({n: batch.column(n) for n in names})  # all columns nullable, as those of results are
            out = reduce(rows if held is None else pa.concat_tables([held, rows]))
            held = pa.table({n: out.column(n) for n in names})
            if held.num_rows > least:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    part = df.mapInArrow(lambda batches: run(batches, _GROUPS), schema)
    salt = free_name(part, "_salt")
    dealt = part.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = dealt.repartition(by, salt).drop(salt).mapInArrow(lambda batches: run(batches, _GROUPS), schema)
    return part.repartition(by).mapInArrow(lambda batches: run(batches, 1 << 62), schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def summed(rows: pa.Table) -> pa.Table:
    """A sample reduction: the sum of ``v`` for each ``g``."""
    out = rows.group_by("g").aggregate([("v", "sum")])
    return pa.table({"g": out.column("g"), "v": out.column("v_sum")})


def user_sum(df: DataFrame, group: str, v: str) -> DataFrame:
    """The sample reduction, over the values of ``group``."""
    rows = df.select(F.col(group).cast("long").alias("g"), F.col(v).cast("long").alias("v"))
    return user_reduce(rows, summed, "g long, v long", "g").select(F.col("g").alias(group), F.col("v").alias("total"))


def sum_serial(df: DataFrame, v: str) -> DataFrame:
    return df.agg(F.sum(F.col(v).cast("long")).alias("total"))


def sum_parallel(df: DataFrame, v: str, parts: int = 64) -> DataFrame:
    """Partial sums by residue, then their sum."""
    part = df.groupBy(F.pmod(F.xxhash64(v), F.lit(parts)).alias("p")).agg(F.sum(F.col(v).cast("long")).alias("s"))
    return part.agg(F.sum("s").alias("total"))
