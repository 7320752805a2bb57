"""Points, boxes, triangles and poses over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from the first three dimensions of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])


def tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), *[F.array(*[F.col("embedding")[3 * v + i].cast("double") for i in range(3)]).alias(f"v{v}") for v in range(3)])


def ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("idx"), (F.col("o_totalprice").cast("double") / 5000.0).alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"), (F.col("o_orderkey") % 100).cast("double").alias("z"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("idx"), (F.col("c_acctbal").cast("double") / 100.0).alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"), (F.col("c_nationkey") * 4).cast("double").alias("z"))


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud without unique ids."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("idx"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount").cast("double") * 100.0).alias("y"), (F.col("l_extendedprice").cast("double") / 2000.0).alias("z"))


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line(spark, sf_dir).groupBy("idx").agg(*[F.min(a).alias(f"min_{a}") for a in "xyz"], *[F.max(a).alias(f"max_{a}") for a in "xyz"])


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(k.cast("long").alias("batch_id"), (k % 5 - 2).cast("double").alias("cam_x"), (F.floor(k / 5) - 2).cast("double").alias("cam_y"), F.lit(3.0).alias("cam_z"))


def event_points(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("idx"), F.floor(F.col("event_id") / 1000).cast("long").alias("batch_id"), F.col("value").cast("double").alias("x"), (F.col("user_id") % 50).cast("double").alias("y"), (F.col("event_id") % 10).cast("double").alias("z")
    )
