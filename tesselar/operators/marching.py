"""Marching cubes over voxels: occupancy or distances to triangles.

The triangulation is derived from two rules. An edge is cut if its ends differ in sign. On each face of the cube, every run of inside
corners is cut off by one segment, so that inside corners at the two ends of a diagonal are apart; faces that cubes share are thus cut
alike, and meshes close. The segments of the six faces form loops, and a loop is a fan of triangles from its lowest edge, seen from outside
in counter-clockwise order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.operators.tsdf import MIN_WEIGHT, value
from tesselar.operators.voxels import KEY

#: Offsets of the eight corners, and the corners of the twelve edges.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))
MAX_TRIANGLES = 500_000


def _faces() -> list[list[int]]:
    """The corners of each face in counter-clockwise order seen from outside."""
    faces = []
    for axis in range(3):
        for side in (0, 1):
            on = [c for c in range(8) if CORNERS[c][axis] == side]
            u, v = (axis + 1) % 3, (axis + 2) % 3
            ring = sorted(on, key=lambda c: ((0, 0), (1, 0), (1, 1), (0, 1)).index((CORNERS[c][u], CORNERS[c][v])))
            faces.append(ring if side else ring[::-1])
    return faces


@cache
def triangulation() -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each of the 256 cases the triangles as edge numbers."""
    number = {frozenset(e): i for i, e in enumerate(EDGES)}
    faces, out = _faces(), []
    for case in range(256):
        follows = {}
        for ring in faces:
            inside = [case >> c & 1 for c in ring]
            for i in range(4):
                if not inside[i] and inside[(i + 1) % 4]:  # a run of inside corners begins here
                    j = (i + 1) % 4
                    while inside[(j + 1) % 4]:
                        j = (j + 1) % 4
                    enters = number[frozenset((ring[i], ring[(i + 1) % 4]))]
                    leaves = number[frozenset((ring[j], ring[(j + 1) % 4]))]
                    follows[enters] = leaves
        triangles, left = [], set(follows)
        while left:
            start = at = min(left)
            loop = []
            while at in left:
                left.discard(at)
                loop.append(at)
                at = follows[at]
            assert at == start
            triangles += [(loop[0], loop[k], loop[k + 1]) for k in range(1, len(loop) - 1)]
        out.append(tuple(triangles))
    return tuple(out)


def cut_edges(case: int) -> int:
    return sum(1 << i for i, (a, b) in enumerate(EDGES) if (case >> a & 1) != (case >> b & 1))


ANCHOR = ("ax", "ay", "az")
#: Edge of a block of cubes as a power of two, and blocks whose corners are held at a time.
BITS = 3
EDGE = 1 << BITS
_BLOCKS = 256
_BLOCK = ("bx", "by", "bz")


def halo_rows(voxels: DataFrame, *cols: str) -> DataFrame:
    """(bx, by, bz, kx, ky, kz, cols): each voxel in the block of cubes it lies in, and in those before it for which it is the outer face.

    A block of 8^3 cubes has 9^3 corners, so of dense voxels a row becomes 1.42 rows, not one for each of its eight cubes."""
    rows = voxels.select(*KEY, *cols)
    for k, b in zip(KEY, _BLOCK):
        own = F.shiftright(k, BITS)
        on_face = F.col(k).bitwiseAND(F.lit(EDGE - 1)) == 0
        rows = rows.withColumn(b, F.explode(F.when(on_face, F.array(own, own - 1)).otherwise(F.array(own))))
    return rows


def _by_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(origin, corners)`` on the corners of some blocks at a time: what it returns are columns of the result.

    ``corners``: an array (blocks, 9, 9, 9), NaN where there is no voxel; ``origin``: the blocks' first anchors."""
    value = rows.columns[3] if len(rows.columns) > 6 else None
    names = [c.split()[0] for c in schema.split(", ")]

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        k, b = (np.stack([table.column(c).to_numpy() for c in cs], 1) for cs in (KEY, _BLOCK))
        v = table.column(value).to_numpy() if value else np.zeros(len(k))
        first = np.r_[True, (b[1:] != b[:-1]).any(1)]
        block = np.cumsum(first) - 1
        origin = b[first] << BITS
        for low in range(0, len(origin), _BLOCKS):
            mine = (block >= low) & (block < low + _BLOCKS)
            some = origin[low : low + _BLOCKS]
            corners = np.full((len(some), EDGE + 1, EDGE + 1, EDGE + 1), np.nan)
            at = k[mine] - some[block[mine] - low]
            corners[block[mine] - low, at[:, 0], at[:, 1], at[:, 2]] = v[mine]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(some, corners)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            b = np.stack([table.column(c).to_numpy() for c in _BLOCK], 1)
            cuts = np.flatnonzero((b[1:] != b[:-1]).any(1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield from solve(table.slice(0, last))
            rest = table.slice(last).combine_chunks()  # one block at most
        if rest is not None and rest.num_rows:
            yield from solve(rest)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(run, schema)


def _corner(corners: np.ndarray, c: int) -> np.ndarray:
    """Corner ``c`` of every cube."""
    x, y, z = CORNERS[c]
    return corners[:, x : x + EDGE, y : y + EDGE, z : z + EDGE]


def _anchors(origin: np.ndarray, found: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    return [origin[found[0], i] + found[1 + i] for i in range(3)]


def cubes(voxels: DataFrame) -> DataFrame:
    """(ax, ay, az, ci) of cubes that the surface of an occupancy grid crosses."""

    def work(origin: np.ndarray, corners: np.ndarray) -> list[np.ndarray]:
        case = sum((~np.isnan(_corner(corners, c))).astype(np.int64) << c for c in range(8))
        found = np.nonzero((case > 0) & (case < 255))
        return [*_anchors(origin, found), case[found]]

    return _by_block(halo_rows(voxels), work, "ax long, ay long, az long, ci long")


def tsdf_cubes(field: DataFrame, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """(ax, ay, az, ci, v0..v7) of cubes with all corners observed that the zero level crosses."""
    seen = value(field.where(F.col("sum_w") >= min_weight))

    def work(origin: np.ndarray, corners: np.ndarray) -> list[np.ndarray]:
        at = [_corner(corners, c) for c in range(8)]
        case = sum((v < 0).astype(np.int64) << c for c, v in enumerate(at))
        found = np.nonzero(~np.isnan(sum(at)) & (case > 0) & (case < 255))
        return [*_anchors(origin, found), case[found], *(v[found] for v in at)]

    return _by_block(halo_rows(seen, "tsdf"), work, "ax long, ay long, az long, ci long, " + ", ".join(f"v{i} double" for i in range(8)))


def _table(spark) -> DataFrame:
    """(ci, tri, e0, e1, e2): 820 rows whatever the input."""
    rows = [(ci, k, *t) for ci, ts in enumerate(triangulation()) for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, "ci long, tri int, e0 int, e1 int, e2 int")


def _vertex(size: float, values: list[Column] | None) -> list[Column]:
    """The twelve edge vertices as structs; a cube lies at its voxels' lower corners."""
    s, out = F.lit(float(size)), []
    for a, b in EDGES:
        if values is None:
            t = F.lit(0.5)
        else:
            dv = values[b] - values[a]
            t = F.when(F.abs(dv) < 1e-6, F.lit(0.5)).otherwise(-values[a] / F.when(F.abs(dv) < 1e-6, F.lit(1.0)).otherwise(dv))
        axis = []
        for i, c in enumerate(ANCHOR):
            p, q = (F.col(c) + CORNERS[a][i]) * s, (F.col(c) + CORNERS[b][i]) * s
            axis.append((p + t * (q - p)).alias("xyz"[i]))
        out.append(F.struct(*axis))
    return out


def _triangles(found: DataFrame, size: float, values: list[Column] | None) -> DataFrame:
    rows = found.join(F.broadcast(_table(found.sparkSession)), "ci")
    corner = F.array(*_vertex(size, values))
    rows = rows.select(*ANCHOR, "tri", *[F.element_at(corner, F.col(f"e{i}") + 1).alias(f"p{i}") for i in range(3)])
    return rows.select(*ANCHOR, "tri", *[F.col(f"p{i}.{a}").alias(f"{a}{i}") for i in range(3) for a in "xyz"])


def mesh(voxels: DataFrame, size: float) -> DataFrame:
    """(ax, ay, az, tri, x0 .. z2): the triangles around an occupancy grid, normals outward."""
    return _triangles(cubes(voxels), size, None)


def tsdf_mesh(field: DataFrame, size: float, min_weight: int = MIN_WEIGHT) -> DataFrame:
    return _triangles(tsdf_cubes(field, min_weight), size, [F.col(f"v{i}") for i in range(8)])


def triangle_count(found: DataFrame) -> DataFrame:
    """The number of triangles of cubes, from the case alone."""
    counts = F.array(*[F.lit(len(t)) for t in triangulation()])
    return found.agg(F.coalesce(F.sum(F.element_at(counts, (F.col("ci") + 1).cast("int"))), F.lit(0)).cast("long").alias("n"))


def limit(triangles: DataFrame, max_triangles: int = MAX_TRIANGLES) -> DataFrame:
    """The first triangles in the order of cubes."""
    return triangles.orderBy(*ANCHOR, "tri").limit(max_triangles)
