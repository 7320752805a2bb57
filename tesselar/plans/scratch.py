"""Tables written once in the folder that the cluster shares, where a plan must not be computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:  # a session of its own, as in tests
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tesselar-"))
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def opened(uri: str):
    """The pyarrow file system of a URI and the path in it."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def save(df: DataFrame, label: str = "table", **options) -> DataFrame:
    path = folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_position(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """Adds the position in the total order ``order``, from 0: a range sort, counts of its partitions, and their sums.

    No task sees more than its own range; the driver sees nothing, and the broadcast side has a row a partition.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ordered = save(ordered, "ordered")
    part = F.shiftright("_m", 33)
    counts = ordered.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_p", before.alias("_s")))
    at = F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("_p", part).join(starts, "_p").withColumn(name, at.cast("long")).drop("_p", "_s", "_m")


def exclusive_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before in ``order``: sums within ranges, and of the ranges before."""
    ordered = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ordered = save(ordered, "ranges")
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ordered.groupBy("_p").agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(totals.select("_p", before.alias("_s")))
    return ordered.withColumn("_w", within).join(starts, "_p").withColumn(name, (F.col("_w") + F.col("_s")).cast("long")).drop("_p", "_s", "_w")
