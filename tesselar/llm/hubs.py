"""Comparison of classes with a representative (hub), dealt over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbered, partitions, tidied

#: Partners of a hub that one task compares.
PORTION = 500


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    few, more = (a, b) if len(a) < len(b) else (b, a)
    shared = int((more[np.minimum(np.searchsorted(more, few), len(more) - 1)] == few).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirmed(pairs: DataFrame, held: DataFrame, test, numbered: Numbered) -> DataFrame:
    """(a, b) of the pairs (hub, class) that pass ``test(data of the class, data of the hub, n of the class, n of the hub)``, by ``held``
    (class, data, n), whose rows lie as the numbered ones do. A hub's data is sent to each of its tasks, a class's once a pair, and no other."""
    scratch = numbered.scratch
    pairs = scratch.save(pairs, "pairs")
    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PORTION).alias("portions"))
    dealt = pairs.join(many, "hub").withColumn("portion", F.pmod(F.xxhash64("class"), F.col("portions")))
    head = F.lit(None).cast("long").alias("class")
    sent = dealt.select("hub", "portion", "class", F.col("class").alias("of")).unionByName(dealt.select("hub", "portion").distinct().select("hub", "portion", head, F.col("hub").alias("of")))
    both = numbered.meet(held.select(F.col("class").alias("of"), "data", "n"), sent, "of").select("hub", "portion", "class", "data", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            a, b = [], []
            for hub, portion, other, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                if other is None:
                    at, head = (hub, portion), (data, n)
                    continue
                assert at == (hub, portion)
                if test(data, head[0], n, head[1]):
                    a.append(hub), b.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    both = both.repartition(partitions(pairs.sparkSession), "hub", "portion").sortWithinPartitions("hub", "portion", F.asc_nulls_first("class"))
    return scratch.save(both.mapInArrow(tidied(run), "a long, b long"), "confirmed")
