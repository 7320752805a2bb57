"""Voxel occupancy: counts a voxel, keys, centres, batches with an optional cap."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselar.functions.morton import MASK32, integer_hash, pack_key, unpack_key, voxel_coord
from tesselar.schema import AXES, finite

KEY = ("kx", "ky", "kz")


class HashKind(Enum):
    """Accepted for compatibility; physical placement is Spark's."""

    WANG = 0


def cap_batches(cloud: DataFrame, max_points: int | None, batch: str = "batch_id", order: str = "idx") -> DataFrame:
    """The first ``max_points`` rows of each batch in ``order`` (None: all)."""
    if max_points is None:
        return cloud
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    return cloud.withColumn("_r", rank).where(F.col("_r") <= max_points).drop("_r")


@dataclass(frozen=True)
class VoxelGrid:
    """A grid of cubes. Points on a face belong to the voxel above it; far voxels never share a key, as the full coordinates are
    grouped and the packed key is only shown."""

    voxel_size: float = 0.1
    max_points: int | None = None
    kind: HashKind = HashKind.WANG

    def coords(self, cloud: DataFrame) -> DataFrame:
        rows = cloud.where(finite(*AXES))
        return rows.select("*", *[voxel_coord(F.col(a).cast("double"), self.voxel_size).alias(k) for a, k in zip(AXES, KEY)])

    def count(self, cloud: DataFrame) -> DataFrame:
        """(kx, ky, kz, key, cnt). Batches simply add up, in any order."""
        if self.max_points is not None:
            cloud = cap_batches(cloud, self.max_points)
        out = self.coords(cloud).groupBy(*KEY).agg(F.count(F.lit(1)).alias("cnt"))
        return out.select(*KEY, pack_key(*map(F.col, KEY)).alias("key"), "cnt")

    def merge(self, *counts: DataFrame) -> DataFrame:
        """Counts of several batches as one."""
        every = counts[0]
        for c in counts[1:]:
            every = every.unionByName(c)
        return every.groupBy(*KEY, "key").agg(F.sum("cnt").alias("cnt"))

    def filled_count(self, cloud: DataFrame) -> DataFrame:
        return self.coords(cloud).select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n"))

    def centers(self, voxels: DataFrame) -> DataFrame:
        """(kx, ky, kz, x, y, z): the middle of each voxel."""
        return voxels.select(*KEY, *[((F.col(k) + 0.5) * F.lit(float(self.voxel_size))).alias(a) for a, k in zip(AXES, KEY)])


def keys(voxels: DataFrame) -> DataFrame:
    """Packed keys and what they unpack to (the coordinates modulo 1024)."""
    key = pack_key(*map(F.col, KEY))
    rows = voxels.select(*KEY, key.alias("key"))
    return rows.select("*", *[u.alias(f"u{a}") for u, a in zip(unpack_key(F.col("key")), AXES)])


def slots(voxels: DataFrame, capacity: int = 1 << 20) -> DataFrame:
    """The hash of each key and the slot it would have in a table of ``capacity``."""
    h = integer_hash(F.col("key"))
    return voxels.select("key", h.alias("h"), (h.bitwiseAND(F.lit(MASK32).cast("long")) % F.lit(capacity).cast("long")).alias("slot"))
