"""Fusion of point clouds into a truncated signed distance field."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions.morton import pack_key, voxel_coord
from tesselar.operators.voxels import KEY
from tesselar.schema import AXES, finite

#: Fixed-point scale of distances and weights.
SCALE = 10_000
MIN_WEIGHT = 5_000
#: Poses that are sent to every task.
FEW = 10_000


@dataclass(frozen=True)
class TSDF:
    voxel_size: float = 0.1
    truncation: float = 0.3

    def samples(self, cloud: DataFrame, *keep: str) -> DataFrame:
        """(kx, ky, kz, dw, and the columns to keep): samples along the ray from (cam_x, cam_y, cam_z) through each point, a voxel's edge apart, within the
        truncation. Two samples in one voxel both count. Points at the camera are dropped."""
        vs = F.lit(float(self.voxel_size))
        steps = math.ceil(self.truncation / self.voxel_size) + 1
        cams = [f"cam_{a}" for a in AXES]
        rows = cloud.where(finite(*AXES, *cams)).select(*[F.col(c).cast("double").alias(c) for c in (*AXES, *cams)], *keep)
        rows = rows.select("*", *[(F.col(a) - F.col(f"cam_{a}")).alias(f"d{a}") for a in AXES])
        rows = rows.withColumn("depth", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))).where("depth >= 1e-6")
        over = F.when(F.col("depth") >= 1e-6, F.col("depth"))  # the optimiser may divide before it filters, and a division by 0 is an error
        rows = rows.select(*AXES, *cams, *keep, "depth", *[(F.col(f"d{a}") / over).alias(f"r{a}") for a in AXES])
        rows = rows.withColumn("t", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
        rows = rows.select("*", *[voxel_coord(F.col(a) + F.col(f"r{a}") * (F.col("t") * vs), self.voxel_size).alias(k) for a, k in zip(AXES, KEY)])
        part = [((F.col(k) + 0.5) * vs - F.col(f"cam_{a}")) * F.col(f"r{a}") for a, k in zip(AXES, KEY)]
        rows = rows.select(*KEY, *keep, (F.col("depth") - (part[0] + part[1] + part[2])).alias("sdf"))
        return rows.where(F.abs("sdf") <= F.lit(float(self.truncation))).select(*KEY, *keep, (F.col("sdf") * float(SCALE)).cast("long").alias("dw"))

    def integrate(self, cloud: DataFrame) -> DataFrame:
        """(kx, ky, kz, key, sum_dw, sum_w) in 64-bit sums, added up before the shuffle."""
        out = self.samples(cloud).groupBy(*KEY).agg(F.sum("dw").alias("sum_dw"), (F.count(F.lit(1)) * SCALE).alias("sum_w"))
        return out.select(*KEY, pack_key(*map(F.col, KEY)).alias("key"), "sum_dw", "sum_w")

    def filled_count(self, cloud: DataFrame) -> DataFrame:
        return self.samples(cloud).select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n"))


def value(field: DataFrame) -> DataFrame:
    """(kx, ky, kz, tsdf): the mean distance."""
    return field.select(*KEY, (F.col("sum_dw").cast("double") / F.col("sum_w").cast("double")).alias("tsdf"))


def visible_points(points: DataFrame, poses: DataFrame, least: float = 0.15) -> DataFrame:
    """Points, taken as positions on a unit sphere, whose outward normal faces the camera by a cosine over ``least``.

    Every point meets every pose, as visibility is a matter of each pair; up to FEW poses are broadcast."""
    rows = points.crossJoin(F.broadcast(poses) if poses.limit(FEW + 1).count() <= FEW else poses)
    d = {a: F.col(f"cam_{a}") - F.col(a) for a in AXES}
    dn = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    pn = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    dot = F.col("x") * d["x"] + F.col("y") * d["y"] + F.col("z") * d["z"]
    return rows.where((dn > 0) & (pn > 0) & (dot / F.when(pn * dn > 0, pn * dn) > F.lit(float(least))))
