"""Generated clouds and camera poses, as distributed ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.schema import AXES


def _grid(spark: SparkSession, low: float, step: float, n: int) -> DataFrame:
    """n x n x n grid points, each index an arithmetic function of the row number."""
    rows = spark.range(n * n * n)
    i = [F.floor(F.col("id") / (n * n)).cast("long"), (F.floor(F.col("id") / n) % n).cast("long"), (F.col("id") % n).cast("long")]
    at = [(F.lit(float(low)) + c * F.lit(float(step))).alias(a) for c, a in zip(i, AXES)]
    return rows.select(F.col("id").alias("idx"), i[0].alias("batch_id"), *at)


def _r2():
    return F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")


def ball_grid(spark: SparkSession, radius: float = 1.0, step: float = 0.1) -> DataFrame:
    """Grid points in a ball; a slice along x is a batch."""
    n = int(math.floor(2 * radius / step + 1e-4)) + 1
    return _grid(spark, -radius, step, n).where(_r2() <= F.lit(float(radius * radius)))


def shell_grid(spark: SparkSession, radius: float = 1.0, voxel_size: float = 0.1, step: float = 0.05) -> DataFrame:
    """Grid points within half a voxel of a sphere."""
    n = int(math.floor(2 * (radius + voxel_size) / step + 1e-4)) + 1
    lo, hi = (radius - voxel_size * 0.5) ** 2, (radius + voxel_size * 0.5) ** 2
    return _grid(spark, -(radius + voxel_size), step, n).where(_r2().between(F.lit(lo), F.lit(hi)))


def camera_orbit(spark: SparkSession, elevations: int = 9, azimuths: int = 36, radius: float = 3.0) -> DataFrame:
    """(batch_id, cam_x, cam_y, cam_z): rings from -80 to 80 degrees."""
    rows = spark.range(elevations * azimuths)
    el = F.radians(F.lit(-80.0) + F.lit(160.0) * F.floor(F.col("id") / azimuths) / max(1, elevations - 1))
    az = F.lit(2.0 * math.pi) * (F.col("id") % azimuths) / azimuths
    r = F.lit(float(radius))
    return rows.select(F.col("id").alias("batch_id"), (r * F.cos(el) * F.cos(az)).alias("cam_x"), (r * F.sin(el)).alias("cam_y"), (r * F.cos(el) * F.sin(az)).alias("cam_z"))


def random_boxes(spark: SparkSession, n: int, seed: int = 42, extent: float = 1000.0) -> DataFrame:
    """Boxes between two uniform points."""
    rows = spark.range(n).select(F.col("id").alias("idx"), *[((F.rand(seed + i) * 2 - 1) * extent).alias(f"r{i}") for i in range(6)])
    return rows.select("idx", *[F.least(f"r{i}", f"r{i + 3}").alias(f"min_{a}") for i, a in enumerate(AXES)], *[F.greatest(f"r{i}", f"r{i + 3}").alias(f"max_{a}") for i, a in enumerate(AXES)])
