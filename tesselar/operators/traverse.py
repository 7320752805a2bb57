"""Walks of many queries down the pages of a spatial index, a level at a time.

A query's frontier is the set of pages that may hold what it seeks. From level to level the frontier is joined with the pages' children, so
no query meets a leaf whose page it could rule out. For nearest neighbours a query first dives: at each level it keeps only the few pages
that reach k primitives soonest, and the k-th primitive found is its bound. A second walk, with the bound known from the top, keeps what
may be nearer. So a query far from everything looks at few pages too, and as bounds compare (distance, id), equal primitives are as
selective as any.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselar.schema import AXES, BOX, finite, points

if TYPE_CHECKING:
    from tesselar.operators.lbvh import SpatialIndex

MAX_K = 64
#: Children of a page, as a power of two.
BITS = 5
#: Pages a level that a dive keeps besides those that surely hold k primitives.
NEAREST = 2
#: Ranges that a condition names; where a frontier meets more, all files are read.
NAMED = 1000
_AT = [f"q{a}" for a in AXES]


def _sum_of_squares(d: list[Column]) -> Column:
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def nearest(at: list[Column]) -> Column:
    """Squared distance from a point to a box, 0 inside."""
    return _sum_of_squares([F.greatest(F.lit(0.0), F.col(f"min_{a}") - c, c - F.col(f"max_{a}")) for a, c in zip(AXES, at)])


def farthest(at: list[Column]) -> Column:
    """Squared distance from a point to the corner of a box that is farthest from it."""
    return _sum_of_squares([F.greatest(F.abs(c - F.col(f"min_{a}")), F.abs(F.col(f"max_{a}") - c)) for a, c in zip(AXES, at)])


def _pages(index: SpatialIndex, level: int, top: bool) -> DataFrame | None:
    """Pages of a level of all runs that have it, or of those whose highest level it is."""
    found = [r.pages(level).withColumn("run", F.lit(i)) for i, r in enumerate(index.runs) if (r.height == level if top else r.height > level)]
    return reduce(DataFrame.unionByName, found) if found else None


def _descend(index: SpatialIndex, queries: DataFrame, prune) -> DataFrame:
    """Rows (query columns, run, page) of the lowest level's pages that are left after ``prune`` at each level."""
    cols, front = queries.columns, None
    for level in range(max(r.height for r in index.runs), 0, -1):
        rows = []
        if front is not None:
            children = _pages(index, level, False).withColumn("up", F.shiftright("page", BITS))
            rows.append(front.withColumnRenamed("page", "up").join(children, ["run", "up"]).drop("up"))
        if (tops := _pages(index, level, True)) is not None:
            rows.append(queries.crossJoin(F.broadcast(tops)))  # TOP pages a run at most
        front = prune(reduce(DataFrame.unionByName, rows)).select(*cols, "run", "page")
    return front


def _leaves(index: SpatialIndex, front: DataFrame) -> DataFrame:
    """The frontier's rows with the leaves of their pages."""
    leaves = [r.leaves().select("idx", *BOX, F.shiftright("pos", BITS).alias("page"), F.lit(i).alias("run")) for i, r in enumerate(index.runs)]
    return front.join(reduce(DataFrame.unionByName, leaves), ["run", "page"])


def with_radius(queries: DataFrame, radius: float | str) -> DataFrame:
    """(idx, box, b2) of query points, with the square of a radius or of the column that has each one's own; rows without one are dropped."""
    own = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    q = queries.select("idx", *[F.col(a).cast("double").alias(f"{m}_{a}") for m in ("min", "max") for a in AXES], (own.cast("double") * own.cast("double")).alias("b2"))
    return q.where(F.col("b2").isNotNull() & ~F.isnan("b2") & finite(*BOX))


def dive(k: int):
    """Keeps the pages by which a query reaches k primitives soonest: those with the nearest farthest corners that hold k, and the
    NEAREST that begin nearest to it."""
    at, one = list(map(F.col, _AT)), ["q", *_AT]

    def prune(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("most", F.struct(farthest(at).alias("d"), F.col("last_idx").alias("i"))).withColumn("least", F.struct(nearest(at).alias("d"), F.col("first_idx").alias("i")))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*one).orderBy("most").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rank = F.row_number().over(Window.partitionBy(*one).orderBy("least"))
        return rows.withColumn("before", before).withColumn("rank", rank).where((F.col("before") < k) | (F.col("rank") <= NEAREST))

    return prune


def within(rows: DataFrame) -> DataFrame:
    """Keeps the pages that may hold a primitive not beyond the query's ``bound``, a distance and an id."""
    least = F.struct(nearest(list(map(F.col, _AT))).alias("d"), F.col("first_idx").alias("i"))
    return rows.where(F.col("bound").isNull() | (least <= F.col("bound")))


def bounds(index: SpatialIndex, q: DataFrame, k: int) -> DataFrame:
    """The queries (q, qx, qy, qz) with a bound: the k-th of the primitives that a dive finds; null if there are not k."""
    found = _leaves(index, _descend(index, q, dive(k))).select("q", *_AT, F.struct(nearest(list(map(F.col, _AT))).alias("d"), F.col("idx").alias("i")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("q", *_AT).orderBy("at"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.groupBy("q", *_AT).agg(F.when(F.count(F.lit(1)) >= k, F.max("at")).alias("bound"))


def require_k(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")


def knn_join(index: SpatialIndex, queries: DataFrame, k: int) -> DataFrame:
    """(q, rank, idx, dist2) of a few queries, of which each reads few pages; tables of queries are joined by ``packed``."""
    require_k(k)
    # equal ids are queries of their own only if they lie apart
    q = points(queries).select(F.col("idx").alias("q"), *[F.col(a).alias(f"q{a}") for a in AXES]).distinct()
    found = _leaves(index, _descend(index, bounds(index, q, k), within)).withColumn("dist2", nearest(list(map(F.col, _AT))))
    rank = F.row_number().over(Window.partitionBy("q", *_AT).orderBy("dist2", "idx")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "idx", "dist2")


def around(index: SpatialIndex, centre: tuple[float, float, float], radius: float) -> DataFrame:
    """(idx, dist2) within the radius of one centre: the box filter reaches the scan of the ranges that the ball meets."""
    at, r = [F.lit(float(c)) for c in centre], abs(float(radius)) * (1 + 1e-9)
    parts = []
    for run in index.runs:
        ranges = run.meeting(centre, radius)
        rows = run.leaves(ranges if len(ranges) <= NAMED else None)
        for a, c in zip(AXES, centre):
            rows = rows.where((F.col(f"max_{a}") >= F.lit(c - r)) & (F.col(f"min_{a}") <= F.lit(c + r)))
        parts.append(rows.select("idx", nearest(at).alias("dist2")))
    return reduce(DataFrame.unionByName, parts).where(F.col("dist2") <= F.lit(float(radius) * float(radius)))
