"""All registered queries of the spatial engine and their SQL equivalents.

Each query takes (spark, sf_dir) and runs over the whole of its tables. Coordinates that come out of interpolation or trigonometry are
returned in millionths, so that both engines give the same integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.functions.morton import HASH_FACTOR, MASK32, SPREAD
from tesselar.operators import kernels, marching, order, search, tsdf, voxels
from tesselar.operators.lbvh import SpatialIndex
from tesselar.plans.scratch import folder, with_position
from tesselar.schema import BOX, canonicalize
from tesselar.sources import generate, ply, views
from tesselar.streaming import blocks, incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ORIGIN = (0.0, 0.0, 0.0)
GRID = voxels.VoxelGrid(1.0)
FINE = voxels.VoxelGrid(0.05)
FIELD = tsdf.TSDF(0.05, 0.15)
WIDE = tsdf.TSDF(5.0, 15.0)
EV_GRID = voxels.VoxelGrid(5.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- SQL views -------------------------------------------------------------------------------------------------------------
EMB = "emb AS (SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
ORD = "ord AS (SELECT o_orderkey AS idx, CAST(o_totalprice AS DOUBLE) / 5000.0::DOUBLE AS x, CAST(o_custkey % 100 AS DOUBLE) AS y, CAST(o_orderkey % 100 AS DOUBLE) AS z FROM orders)"
LINE = "line AS (SELECT l_orderkey AS idx, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) * 100.0::DOUBLE AS y, CAST(l_extendedprice AS DOUBLE) / 2000.0::DOUBLE AS z FROM lineitem)"
BOXES = LINE + ", box AS (SELECT idx, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM line GROUP BY idx)"
EV = "ev AS (SELECT event_id AS idx, CAST(floor(event_id / 1000.0) AS BIGINT) AS batch_id, CAST(value AS DOUBLE) AS x, CAST(user_id % 50 AS DOUBLE) AS y, CAST(event_id % 10 AS DOUBLE) AS z FROM events)"
POSES = "poses AS (SELECT CAST(n_nationkey AS BIGINT) AS batch_id, CAST(n_nationkey % 5 - 2 AS DOUBLE) AS cam_x, CAST(floor(n_nationkey / 5.0) - 2 AS DOUBLE) AS cam_y, CAST(3.0 AS DOUBLE) AS cam_z FROM nation)"


def _box_d2(x: str, y: str, z: str) -> str:
    d = [f"greatest(0.0::DOUBLE, min_{a} - {c}, {c} - max_{a})" for a, c in zip("xyz", (x, y, z))]
    return " + ".join(f"({v}) * ({v})" for v in d)


def _voxel(size: float, src: str, cols: str = "") -> str:
    k = ", ".join(f"CAST(floor({a} / {size}::DOUBLE) AS BIGINT) AS k{a}" for a in "xyz")
    return f"SELECT {cols}{k} FROM {src}"


KEY_SQL = "(((kx + 512) & 1023) << 20) | (((ky + 512) & 1023) << 10) | ((kz + 512) & 1023)"
D2 = "x * x + y * y + z * z"

# ---- radius and nearest neighbours -----------------------------------------------------------------------------------------


@query(f"WITH {EMB} SELECT idx, {D2} AS dist2 FROM emb WHERE {D2} <= 0.2::DOUBLE * 0.2::DOUBLE")
def radius_search(spark, sf):
    return search.radius_search(views.emb(spark, sf), ORIGIN, 0.2)


@query(f"WITH {EMB} SELECT count(*) AS n FROM emb WHERE {D2} <= 0.2::DOUBLE * 0.2::DOUBLE")
def radius_count(spark, sf):
    return search.radius_count(views.emb(spark, sf), ORIGIN, 0.2)


@query(f"WITH {BOXES}, d AS (SELECT idx, {_box_d2('25.0::DOUBLE', '5.0::DOUBLE', '20.0::DOUBLE')} AS dist2 FROM box) SELECT idx, dist2 FROM d WHERE dist2 <= 4.0")
def radius_search_boxes(spark, sf):
    return search.radius_search(views.box(spark, sf), (25.0, 5.0, 20.0), 2.0, "boxes")


TRIS = "tri AS (SELECT vec_id AS idx, " + ", ".join(f"{g}({', '.join(f'CAST(embedding[{3 * v + i + 1}] AS DOUBLE)' for v in range(3))}) AS {m}_{a}" for m, g in (("min", "least"), ("max", "greatest")) for i, a in enumerate("xyz")) + " FROM embeddings)"


@query(f"WITH {TRIS}, d AS (SELECT idx, {_box_d2('0.0::DOUBLE', '0.0::DOUBLE', '0.0::DOUBLE')} AS dist2 FROM tri) SELECT idx, dist2 FROM d WHERE dist2 <= 0.05::DOUBLE * 0.05::DOUBLE")
def radius_search_triangles(spark, sf):
    return search.radius_search(views.tri(spark, sf), ORIGIN, 0.05, "triangles")


PAIR_D2 = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)"


@query(f"WITH {EMB} SELECT a.idx AS q, b.idx AS idx, {PAIR_D2} AS dist2 FROM emb a JOIN emb b ON {PAIR_D2} <= 0.1::DOUBLE * 0.1::DOUBLE")
def radius_join(spark, sf):
    pts = views.emb(spark, sf)
    return search.radius_join(pts, pts, 0.1)


@query(
    f"WITH {EMB}, {TRIS}, d AS (SELECT e.idx AS q, t.idx AS idx, {_box_d2('e.x', 'e.y', 'e.z')} AS dist2 FROM emb e, tri t) SELECT q, idx, dist2 FROM d WHERE dist2 <= 0.02::DOUBLE * 0.02::DOUBLE"
)
def radius_join_boxes(spark, sf):
    return search.radius_join(views.emb(spark, sf), views.tri(spark, sf), 0.02, "triangles")


@query(f"WITH {EMB}, d AS (SELECT idx, {D2} AS dist2 FROM emb), r AS (SELECT row_number() OVER (ORDER BY dist2, idx) AS rank, idx, dist2 FROM d) SELECT * FROM r WHERE rank <= 10")
def knn(spark, sf):
    return search.knn(views.emb(spark, sf), ORIGIN, 10)


@query(
    f"WITH {BOXES}, d AS (SELECT idx, {_box_d2('25.0::DOUBLE', '5.0::DOUBLE', '60.0::DOUBLE')} AS dist2 FROM box), r AS (SELECT row_number() OVER (ORDER BY dist2, idx) AS rank, idx, dist2 FROM d) SELECT * FROM r WHERE rank <= 16"
)
def knn_boxes(spark, sf):
    return search.knn(views.box(spark, sf), (25.0, 5.0, 60.0), 16, "boxes")


@query(f"WITH {EMB}, d AS (SELECT a.idx AS q, b.idx AS idx, {PAIR_D2} AS dist2 FROM emb a, emb b), r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY dist2, idx) AS rank, idx, dist2 FROM d) SELECT * FROM r WHERE rank <= 5")
def knn_join(spark, sf):
    pts = views.emb(spark, sf)
    return search.knn_join(pts, pts, 5)


@query(
    f"WITH {EMB}, {TRIS}, d AS (SELECT e.idx AS q, t.idx AS idx, {_box_d2('e.x', 'e.y', 'e.z')} AS dist2 FROM emb e, tri t), r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY dist2, idx) AS rank, idx, dist2 FROM d) SELECT * FROM r WHERE rank <= 3"
)
def knn_join_boxes(spark, sf):
    return search.knn_join(views.emb(spark, sf), views.tri(spark, sf), 3, "triangles")


# ---- a written index that is searched --------------------------------------------------------------------------------------

CUST = "cust AS (SELECT c_custkey AS idx, CAST(c_acctbal AS DOUBLE) / 100.0::DOUBLE AS x, CAST(c_custkey % 100 AS DOUBLE) AS y, CAST(c_nationkey * 4 AS DOUBLE) AS z FROM customer)"
OWN = "0.05::DOUBLE + CAST(a.idx % 8 AS DOUBLE) * 0.01::DOUBLE"


@query(f"WITH {EMB} SELECT a.idx AS q, b.idx AS idx, {PAIR_D2} AS dist2 FROM emb a JOIN emb b ON {PAIR_D2} <= ({OWN}) * ({OWN})")
def radius_join_index(spark, sf):
    """A radius of its own for each query."""
    pts = views.emb(spark, sf)
    return SpatialIndex.build(pts).radius_join(pts.withColumn("r", F.lit(0.05) + (F.col("idx") % 8).cast("double") * F.lit(0.01)), "r")


@query(f"WITH {ORD}, {CUST}, d AS (SELECT a.idx AS q, b.idx AS idx, {PAIR_D2} AS dist2 FROM cust a, ord b), r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY dist2, idx) AS rank, idx, dist2 FROM d) SELECT * FROM r WHERE rank <= 7")
def knn_join_index(spark, sf):
    return SpatialIndex.build(views.ord(spark, sf)).knn_join(views.customers(spark, sf), 7)


@query(f"WITH {BOXES}, {CUST}, d AS (SELECT c.idx AS q, b.idx AS idx, {_box_d2('c.x', 'c.y', 'c.z')} AS dist2 FROM cust c, box b), r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY dist2, idx) AS rank, idx, dist2 FROM d) SELECT * FROM r WHERE rank <= 3")
def knn_join_appended(spark, sf):
    """Boxes that came in three batches: a build and two appends."""
    boxes, kept = views.box(spark, sf), folder(spark, "kept-index")
    part = lambda i: boxes.where(F.col("idx") % 3 == i)
    SpatialIndex.build(part(0), "boxes", kept)
    SpatialIndex.open(spark, kept).append(part(1)).append(part(2))
    return SpatialIndex.open(spark, kept).knn_join(views.customers(spark, sf), 3)


@query(f"WITH {BOXES}, d AS (SELECT idx, {_box_d2('25.0::DOUBLE', '5.0::DOUBLE', '20.0::DOUBLE')} AS dist2 FROM box) SELECT idx, dist2 FROM d WHERE dist2 <= 4.0")
def radius_search_index(spark, sf):
    return SpatialIndex.build(views.box(spark, sf), "boxes").radius_search((25.0, 5.0, 20.0), 2.0)


# ---- primitives ------------------------------------------------------------------------------------------------------------


@query(f"WITH {ORD} SELECT idx, x AS min_x, y AS min_y, z AS min_z, x AS max_x, y AS max_y, z AS max_z FROM ord")
def prim_from_points(spark, sf):
    return canonicalize(views.ord(spark, sf), "points")


@query(f"WITH {TRIS} SELECT * FROM tri")
def prim_from_triangles(spark, sf):
    return canonicalize(views.tri(spark, sf), "triangles")


@query(f"WITH {BOXES} SELECT * FROM box")
def prim_from_boxes(spark, sf):
    return canonicalize(views.box(spark, sf), "boxes")


@query(f"WITH {BOXES} SELECT idx, (min_x + max_x) * 0.5::DOUBLE AS cx, (min_y + max_y) * 0.5::DOUBLE AS cy, (min_z + max_z) * 0.5::DOUBLE AS cz FROM box")
def box_centers(spark, sf):
    return order.box_centers(canonicalize(views.box(spark, sf), "boxes"))


@query(f"WITH {BOXES} SELECT count(*) AS n, min(min_x) AS min_x, min(min_y) AS min_y, min(min_z) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z FROM box")
def scene_bounds(spark, sf):
    return order.scene_bounds(canonicalize(views.box(spark, sf), "boxes"))


# ---- Morton codes and radix sort -------------------------------------------------------------------------------------------


_STEPS = ", ".join(
    f"s{n + 1} AS (SELECT idx, " + ", ".join(f"((m{a} | (m{a} << {s})) & {m}) AS m{a}" for a in "xyz") + f" FROM s{n})"
    for n, (s, m) in enumerate(SPREAD)
)
_UNIT = ", ".join(f"CAST(floor(least(greatest(((({a} + {a}) * 0.5::DOUBLE - lo_{a}) / greatest(hi_{a} - lo_{a}, 1e-8::DOUBLE)) * 1024.0::DOUBLE, 0.0::DOUBLE), 1023.0::DOUBLE)) AS BIGINT) AS m{a}" for a in "xyz")
CODES = f"{ORD}, gb AS (SELECT " + ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in "xyz") + f" FROM ord), s0 AS (SELECT idx, {_UNIT} FROM ord, gb), {_STEPS}, codes AS (SELECT idx, (mx << 2) | (my << 1) | mz AS code FROM s4)"
SORTED = CODES + ", sorted AS (SELECT idx, code, row_number() OVER (ORDER BY code, idx) - 1 AS pos FROM codes)"
PLACED = CODES + ", placed AS (SELECT idx, code, row_number() OVER (ORDER BY idx) - 1 AS pos FROM codes)"


def _codes(spark, sf):
    return order.morton_code(canonicalize(views.ord(spark, sf), "points")).select("idx", "code")


@query(f"WITH {CODES} SELECT idx, code FROM codes")
def morton_code(spark, sf):
    return _codes(spark, sf)


@query(f"WITH {CODES} SELECT c.idx, c.code, s.mx, s.my, s.mz, s.mx / 1024.0::DOUBLE AS ux, s.my / 1024.0::DOUBLE AS uy, s.mz / 1024.0::DOUBLE AS uz FROM codes c JOIN s0 s ON c.idx = s.idx")
def morton_decode(spark, sf):
    return order.morton_decode(_codes(spark, sf))


@query(f"WITH {SORTED} SELECT idx, code, pos FROM sorted")
def morton_sort(spark, sf):
    return order.morton_sort(_codes(spark, sf))


def _placed(spark, sf):
    return with_position(_codes(spark, sf), "idx")


HIST = PLACED + ", hist AS (SELECT code & 15 AS digit, pos // 256 AS wg, count(*) AS cnt FROM placed GROUP BY 1, 2)"
OFFS = HIST + ", offs AS (SELECT digit, wg, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY digit, wg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM hist)"


@query(f"WITH {HIST} SELECT digit, wg, cnt FROM hist")
def radix_histogram(spark, sf):
    return order.radix_histogram(_placed(spark, sf))


@query(f"WITH {OFFS} SELECT digit, wg, cnt, start FROM offs")
def radix_offsets(spark, sf):
    return order.radix_offsets(order.radix_histogram(_placed(spark, sf)))


@query(f"WITH {PLACED} SELECT idx, code, pos, row_number() OVER (ORDER BY code & 15, pos) - 1 AS new_pos FROM placed")
def radix_scatter(spark, sf):
    return order.radix_scatter(_placed(spark, sf))


# ---- hierarchy -------------------------------------------------------------------------------------------------------------

_NODES = (
    SORTED
    + """, leaf AS (SELECT s.idx, s.code, s.pos, (s.code << 32) | s.pos AS key, o.x, o.y, o.z FROM sorted s JOIN ord o ON s.idx = o.idx),
diff AS (SELECT pos, xor(key, lead(key) OVER (ORDER BY pos)) AS dn, xor(key, lag(key) OVER (ORDER BY pos)) AS up FROM leaf),
total AS (SELECT count(*) AS n FROM leaf),
g AS (SELECT lv, key >> CAST(63 - lv AS INTEGER) AS pre, min(pos) AS first_pos, max(pos) AS last_pos, max(pos) FILTER (WHERE (key >> CAST(62 - lv AS INTEGER)) & 1 = 0) AS split,
        max((key >> CAST(62 - lv AS INTEGER)) & 1) AS ones, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z
      FROM leaf, range(0, 63) r(lv) GROUP BY 1, 2),
node AS (SELECT CASE WHEN dl.dn IS NOT NULL AND (df.up IS NULL OR dl.dn < df.up) THEN last_pos ELSE first_pos END AS node_id,
         CASE WHEN split = first_pos THEN n - 1 + split ELSE split END AS left_id, CASE WHEN split + 1 = last_pos THEN n + split ELSE split + 1 END AS right_id,
         first_pos, last_pos, split, CAST(lv AS INTEGER) AS level, min_x, min_y, min_z, max_x, max_y, max_z
       FROM g JOIN diff dl ON dl.pos = last_pos JOIN diff df ON df.pos = first_pos, total WHERE split IS NOT NULL AND ones = 1)"""
)
_BOXES = ", ".join(BOX)
_ALL = """, every AS (SELECT node_id, left_id{0} AS left_id, right_id{0} AS right_id, CAST(NULL AS BIGINT) AS prim_idx, first_pos, last_pos, false AS is_leaf, min_x, min_y, min_z, max_x, max_y, max_z FROM node
UNION ALL SELECT n - 1 + pos, NULL, NULL, idx, pos, pos, true, x, y, z, x, y, z FROM leaf, total)"""
_PARENT = ", parent AS (SELECT left_id AS child_id, node_id AS parent_id FROM node UNION ALL SELECT right_id, node_id FROM node UNION ALL SELECT 0, 0)"


def _index(spark, sf):
    return SpatialIndex.build(views.ord(spark, sf))


@query(f"WITH {_NODES} SELECT n - 1 + pos AS node_id, pos, idx AS prim_idx, code, x AS min_x, y AS min_y, z AS min_z, x AS max_x, y AS max_y, z AS max_z FROM leaf, total")
def lbvh_leaves(spark, sf):
    return _index(spark, sf).leaf_nodes()


@query(f"WITH {_NODES} SELECT node_id, left_id, right_id, first_pos, last_pos, split, level, {_BOXES} FROM node")
def lbvh_nodes(spark, sf):
    return _index(spark, sf).internal_nodes()


@query(f"WITH {_NODES}{_ALL.format(' - node_id')} SELECT node_id, left_id, right_id, prim_idx, first_pos, last_pos, is_leaf, {_BOXES} FROM every")
def lbvh_nodes_relative(spark, sf):
    return _index(spark, sf).nodes(relative=True)


@query(f"WITH {_NODES}{_PARENT} SELECT child_id, parent_id FROM parent")
def lbvh_parents(spark, sf):
    return _index(spark, sf).parents()


@query(f"WITH {_NODES} SELECT node_id, CAST(2 AS BIGINT) AS n_children, true AS covers FROM node")
def lbvh_children(spark, sf):
    return _index(spark, sf).children()


@query(
    f"WITH RECURSIVE {_NODES}{_PARENT}, walk AS (SELECT CAST(0 AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS depth UNION ALL SELECT p.child_id, w.depth + 1 FROM walk w JOIN parent p ON p.parent_id = w.node_id AND p.child_id <> 0) SELECT node_id, depth FROM walk"
)
def lbvh_depth(spark, sf):
    return _index(spark, sf).depths()


def _tree_sql(src: str) -> str:
    """The internal nodes over a view of boxes (idx, min_x .. max_z), whose scene and codes are taken here."""
    lo_hi = ", ".join(f"min(min_{a}) AS lo_{a}, max(max_{a}) AS hi_{a}" for a in "xyz")
    unit = ", ".join(f"CAST(floor(least(greatest((((min_{a} + max_{a}) * 0.5::DOUBLE - lo_{a}) / greatest(hi_{a} - lo_{a}, 1e-8::DOUBLE)) * 1024.0::DOUBLE, 0.0::DOUBLE), 1023.0::DOUBLE)) AS BIGINT) AS m{a}" for a in "xyz")
    box = ", ".join(f"{f}({f}_{a}) AS {f}_{a}" for f in ("min", "max") for a in "xyz")
    return f"""gb AS (SELECT {lo_hi} FROM {src}), s0 AS (SELECT {src}.*, {unit} FROM {src}, gb), {_STEPS.replace("SELECT idx,", "SELECT * REPLACE (").replace(" FROM s", ") FROM s")},
leaf AS (SELECT *, row_number() OVER (ORDER BY (mx << 2) | (my << 1) | mz, idx) - 1 AS pos FROM s4), keyed AS (SELECT *, (((mx << 2) | (my << 1) | mz) << 32) | pos AS key FROM leaf),
diff AS (SELECT pos, xor(key, lead(key) OVER (ORDER BY pos)) AS dn, xor(key, lag(key) OVER (ORDER BY pos)) AS up FROM keyed), total AS (SELECT count(*) AS n FROM leaf),
g AS (SELECT lv, key >> CAST(63 - lv AS INTEGER) AS pre, min(pos) AS first_pos, max(pos) AS last_pos, max(pos) FILTER (WHERE (key >> CAST(62 - lv AS INTEGER)) & 1 = 0) AS split,
        max((key >> CAST(62 - lv AS INTEGER)) & 1) AS ones, {box} FROM keyed, range(0, 63) r(lv) GROUP BY 1, 2)
SELECT CASE WHEN dl.dn IS NOT NULL AND (df.up IS NULL OR dl.dn < df.up) THEN last_pos ELSE first_pos END AS node_id,
       CASE WHEN split = first_pos THEN n - 1 + split ELSE split END AS left_id, CASE WHEN split + 1 = last_pos THEN n + split ELSE split + 1 END AS right_id,
       first_pos, last_pos, split, CAST(lv AS INTEGER) AS level, {_BOXES}
FROM g JOIN diff dl ON dl.pos = last_pos JOIN diff df ON df.pos = first_pos, total WHERE split IS NOT NULL AND ones = 1"""


@query(f"WITH {BOXES}, {_tree_sql('box')}")
def lbvh_nodes_boxes(spark, sf):
    return SpatialIndex.build(views.box(spark, sf), "boxes").internal_nodes()


@query(f"WITH {TRIS}, {_tree_sql('tri')}")
def lbvh_nodes_triangles(spark, sf):
    return SpatialIndex.build(views.tri(spark, sf), "triangles").internal_nodes()


# ---- voxels ----------------------------------------------------------------------------------------------------------------

_V = f"{LINE}, v AS ({_voxel(1.0, 'line')}), vox AS (SELECT kx, ky, kz, {KEY_SQL} AS key, count(*) AS cnt FROM v GROUP BY kx, ky, kz)"
_EV = f"{EV}, v AS ({_voxel(5.0, 'ev', 'batch_id, idx, ')})"


@query(f"WITH {_V} SELECT kx, ky, kz, key, cnt FROM vox")
def voxel_count(spark, sf):
    return GRID.count(views.line(spark, sf))


@query(f"WITH {_V} SELECT count(*) AS n FROM vox")
def voxel_filled_count(spark, sf):
    return GRID.filled_count(views.line(spark, sf))


@query(f"WITH {_V} SELECT kx, ky, kz, key, ((key >> 20) & 1023) - 512 AS ux, ((key >> 10) & 1023) - 512 AS uy, (key & 1023) - 512 AS uz FROM vox")
def voxel_key(spark, sf):
    return voxels.keys(GRID.count(views.line(spark, sf)))


@query(f"WITH {_V} SELECT kx, ky, kz, (kx + 0.5::DOUBLE) * 1.0::DOUBLE AS x, (ky + 0.5::DOUBLE) * 1.0::DOUBLE AS y, (kz + 0.5::DOUBLE) * 1.0::DOUBLE AS z FROM vox")
def voxel_centers(spark, sf):
    return GRID.centers(GRID.count(views.line(spark, sf)))


@query(f"WITH {_V}, a AS (SELECT key, xor(key, key >> 16) AS k FROM vox), b AS (SELECT key, (k * {HASH_FACTOR}) & {MASK32} AS k FROM a), c AS (SELECT key, xor(k, k >> 16) AS h FROM b) SELECT key, h, h % 1048576 AS slot FROM c")
def wang_hash(spark, sf):
    return voxels.slots(GRID.count(views.line(spark, sf)))


@query(f"WITH {_EV} SELECT kx, ky, kz, {KEY_SQL} AS key, count(*) AS cnt FROM v GROUP BY kx, ky, kz")
def voxel_multi_batch(spark, sf):
    ev = views.event_points(views.table(spark, sf, "events"))
    first = ev.where(F.col("batch_id") % 2 == 0)
    return EV_GRID.merge(EV_GRID.count(first), EV_GRID.count(ev.where(F.col("batch_id") % 2 != 0)))


@query(f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY idx) AS r FROM v) SELECT kx, ky, kz, {KEY_SQL} AS key, count(*) AS cnt FROM r WHERE r <= 500 GROUP BY kx, ky, kz")
def batch_cap(spark, sf):
    return voxels.VoxelGrid(5.0, max_points=500).count(views.event_points(views.table(spark, sf, "events")))


# ---- distance fields -------------------------------------------------------------------------------------------------------


def _samples(src: str, vs: float, trunc: float, steps: int) -> str:
    d = "s0d AS (SELECT *, x - cam_x AS dx, y - cam_y AS dy, z - cam_z AS dz FROM {0}), s1d AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS depth FROM s0d), s2d AS (SELECT *, dx / depth AS rx, dy / depth AS ry, dz / depth AS rz FROM s1d WHERE depth >= 1e-6)"
    k = ", ".join(f"CAST(floor(({a} + r{a} * (t * {vs}::DOUBLE)) / {vs}::DOUBLE) AS BIGINT) AS k{a}" for a in "xyz")
    p = " + ".join(f"((k{a} + 0.5::DOUBLE) * {vs}::DOUBLE - cam_{a}) * r{a}" for a in "xyz")
    return (
        d.format(src)
        + f", s3d AS (SELECT *, {k} FROM s2d, range({-steps}, {steps + 1}) r(t)), s4d AS (SELECT kx, ky, kz, depth - ({p}) AS sdf FROM s3d)"
        + f", field AS (SELECT kx, ky, kz, {KEY_SQL} AS key, CAST(sum(CAST(trunc(sdf * 10000.0::DOUBLE) AS BIGINT)) AS BIGINT) AS sum_dw, count(*) * 10000 AS sum_w FROM s4d WHERE abs(sdf) <= {trunc}::DOUBLE GROUP BY kx, ky, kz)"
    )


_SEEN = f"{EMB}, seen AS (SELECT *, 0.0::DOUBLE AS cam_x, 0.0::DOUBLE AS cam_y, 1.0::DOUBLE AS cam_z FROM emb)"
_FIELD = f"{_SEEN}, {_samples('seen', 0.05, 0.15, 4)}"


def _seen(spark, sf):
    return views.emb(spark, sf).select("*", F.lit(0.0).alias("cam_x"), F.lit(0.0).alias("cam_y"), F.lit(1.0).alias("cam_z"))


@query(f"WITH {_FIELD} SELECT kx, ky, kz, key, sum_dw, sum_w FROM field")
def tsdf_integrate(spark, sf):
    return FIELD.integrate(_seen(spark, sf))


@query(f"WITH {_FIELD} SELECT kx, ky, kz, CAST(sum_dw AS DOUBLE) / CAST(sum_w AS DOUBLE) AS tsdf FROM field")
def tsdf_value(spark, sf):
    return tsdf.value(FIELD.integrate(_seen(spark, sf)))


@query(f"WITH {_FIELD} SELECT count(*) AS n FROM field")
def tsdf_filled_count(spark, sf):
    return FIELD.filled_count(_seen(spark, sf))


# ---- marching cubes --------------------------------------------------------------------------------------------------------

_CORNER = "corner(c, ox, oy, oz) AS (VALUES " + ", ".join(f"({c}, {x}, {y}, {z})" for c, (x, y, z) in enumerate(marching.CORNERS)) + ")"
_EDGE = "edge(e, " + ", ".join(f"{p}{a}" for p in "pq" for a in "xyz") + ", ca, cb) AS (VALUES " + ", ".join(f"({e}, {', '.join(map(str, (*marching.CORNERS[a], *marching.CORNERS[b])))}, {a}, {b})" for e, (a, b) in enumerate(marching.EDGES)) + ")"
_TABLE = "tt(ci, tri, v, e) AS (VALUES " + ", ".join(f"({ci}, {k}, {v}, {e})" for ci, ts in enumerate(marching.triangulation()) for k, t in enumerate(ts) for v, e in enumerate(t)) + ")"
_CUBES = f"{_CORNER}, cube AS (SELECT kx - ox AS ax, ky - oy AS ay, kz - oz AS az, CAST(sum(1 << c) AS BIGINT) AS ci FROM (SELECT DISTINCT kx, ky, kz FROM vox) s, corner GROUP BY 1, 2, 3 HAVING sum(1 << c) NOT IN (0, 255))"
_FCUBES = (
    f"{_CORNER}, tv AS (SELECT kx, ky, kz, CAST(sum_dw AS DOUBLE) / CAST(sum_w AS DOUBLE) AS tsdf FROM field WHERE sum_w >= 5000)"
    ", cube AS (SELECT kx - ox AS ax, ky - oy AS ay, kz - oz AS az, CAST(sum(CASE WHEN tsdf < 0 THEN 1 << c ELSE 0 END) AS BIGINT) AS ci, "
    + ", ".join(f"max(tsdf) FILTER (WHERE c = {i}) AS v{i}" for i in range(8))
    + " FROM tv, corner GROUP BY 1, 2, 3 HAVING count(*) = 8 AND sum(CASE WHEN tsdf < 0 THEN 1 << c ELSE 0 END) NOT IN (0, 255))"
)


def _mesh_sql(size: float, field: bool) -> str:
    vals = "list_value(" + ", ".join(f"v{i}" for i in range(8)) + ")"
    if field:
        t = f"CASE WHEN abs({vals}[cb + 1] - {vals}[ca + 1]) < 1e-6 THEN 0.5::DOUBLE ELSE -({vals}[ca + 1]) / ({vals}[cb + 1] - {vals}[ca + 1]) END"
    else:
        t = "0.5::DOUBLE"
    c = ", ".join(f"(a{a} + p{a}) * {size}::DOUBLE + tt0 * ((a{a} + q{a}) * {size}::DOUBLE - (a{a} + p{a}) * {size}::DOUBLE) AS {a}" for a in "xyz")
    return (
        f"{_EDGE}, {_TABLE}, w0 AS (SELECT ax, ay, az, tri, v, edge.*, {t} AS tt0 FROM cube JOIN tt ON cube.ci = tt.ci JOIN edge ON edge.e = tt.e), w1 AS (SELECT ax, ay, az, tri, v, {c} FROM w0)"
        + ", mesh AS (SELECT ax, ay, az, tri, "
        + ", ".join(f"CAST(round(max({a}) FILTER (WHERE v = {i}) * 1e6) AS BIGINT) AS {a}{i}" for i in range(3) for a in "xyz")
        + " FROM w1 GROUP BY ax, ay, az, tri)"
    )


_COORDS = [f"{a}{i}" for i in range(3) for a in "xyz"]
_MCOLS = "ax, ay, az, CAST(tri AS INTEGER) AS tri, " + ", ".join(_COORDS)


def _rounded(m: DataFrame) -> DataFrame:
    return m.select("ax", "ay", "az", "tri", *[ply.micro(F.col(c)).alias(c) for c in _COORDS])


@query(f"WITH {_V}, {_CUBES} SELECT ax, ay, az, ci FROM cube")
def mc_cubes(spark, sf):
    return marching.cubes(GRID.count(views.line(spark, sf)))


@query(f"WITH {_V}, {_CUBES}, {_mesh_sql(1.0, False)} SELECT {_MCOLS} FROM mesh")
def mc_triangles(spark, sf):
    return _rounded(marching.mesh(GRID.count(views.line(spark, sf)), 1.0))


@query(f"WITH {_V}, {_CUBES}, {_TABLE} SELECT count(*) AS n FROM cube JOIN tt ON cube.ci = tt.ci WHERE v = 0")
def mc_triangle_count(spark, sf):
    return marching.triangle_count(marching.cubes(GRID.count(views.line(spark, sf))))


@query(f"WITH {_V}, {_CUBES}, {_mesh_sql(1.0, False)} SELECT {_MCOLS} FROM mesh ORDER BY ax, ay, az, tri LIMIT 1000")
def mc_limit(spark, sf):
    return _rounded(marching.limit(marching.mesh(GRID.count(views.line(spark, sf)), 1.0), 1000))


@query(f"WITH {_FIELD}, {_FCUBES}, {_mesh_sql(0.05, True)} SELECT {_MCOLS} FROM mesh")
def tsdf_mesh(spark, sf):
    return _rounded(marching.tsdf_mesh(FIELD.integrate(_seen(spark, sf)), 0.05))


# ---- PLY lines -------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {_FIELD}, {_FCUBES}, {_mesh_sql(0.05, True)}, o AS (SELECT *, row_number() OVER (ORDER BY ax, ay, az, tri) - 1 AS t, count(*) OVER () AS n FROM mesh) "
    + " UNION ALL ".join(f"SELECT t * 3 + {i} AS line_no, 'vertex' AS kind, x{i} AS a, y{i} AS b, z{i} AS c FROM o" for i in range(3))
    + " UNION ALL SELECT n * 3 + t, 'face', t * 3, t * 3 + 1, t * 3 + 2 FROM o"
)
def ply_mesh_lines(spark, sf):
    return ply.mesh_lines(marching.tsdf_mesh(FIELD.integrate(_seen(spark, sf)), 0.05))


@query(
    f"WITH {_V}, {_CUBES}, {_mesh_sql(1.0, False)}, o AS (SELECT {_MCOLS}, row_number() OVER (ORDER BY ax, ay, az, tri) - 1 AS t, count(*) OVER () AS n FROM mesh) "
    + " UNION ALL ".join(f"SELECT t * 3 + {i} AS line_no, 'vertex' AS kind, x{i} AS a, y{i} AS b, z{i} AS c FROM o" for i in range(3))
    + " UNION ALL SELECT n * 3 + t, 'face', t * 3, t * 3 + 1, t * 3 + 2 FROM o"
)
def ply_voxel_mesh_lines(spark, sf):
    return ply.mesh_lines(marching.mesh(GRID.count(views.line(spark, sf)), 1.0))


@query(f"WITH {EMB} SELECT row_number() OVER (ORDER BY idx) - 1 AS line_no, CAST(round(x * 1e6) AS BIGINT) AS a, CAST(round(y * 1e6) AS BIGINT) AS b, CAST(round(z * 1e6) AS BIGINT) AS c FROM emb")
def ply_point_lines(spark, sf):
    return ply.point_lines(views.emb(spark, sf))


# ---- generated clouds ------------------------------------------------------------------------------------------------------


def _grid_sql(low: float, step: float, n: int) -> str:
    at = ", ".join(f"{low}::DOUBLE + i{a} * {step}::DOUBLE AS {a}" for a in "xyz")
    return f"g AS (SELECT (ix * {n} + iy) * {n} + iz AS idx, ix AS batch_id, {at} FROM range({n}) a(ix), range({n}) b(iy), range({n}) c(iz))"


@query(f"WITH {_grid_sql(-1.0, 0.1, 21)} SELECT idx, batch_id, x, y, z FROM g WHERE {D2} <= 1.0::DOUBLE")
def gen_ball_grid(spark, sf):
    return generate.ball_grid(spark)


@query(f"WITH {_grid_sql(-1.1, 0.05, 45)} SELECT idx, batch_id, x, y, z FROM g WHERE {D2} BETWEEN {(1.0 - 0.1 * 0.5) ** 2}::DOUBLE AND {(1.0 + 0.1 * 0.5) ** 2}::DOUBLE")
def gen_shell_grid(spark, sf):
    return generate.shell_grid(spark)


_ORBIT = "orbit AS (SELECT i AS batch_id, radians(-80.0::DOUBLE + 160.0::DOUBLE * (i // 36) / 8) AS el, 2.0::DOUBLE * pi() * (i % 36) / 36 AS az FROM range(324) r(i))"


@query(f"WITH {_ORBIT} SELECT batch_id, CAST(round(3.0::DOUBLE * cos(el) * cos(az) * 1e6) AS BIGINT) AS cam_x, CAST(round(3.0::DOUBLE * sin(el) * 1e6) AS BIGINT) AS cam_y, CAST(round(3.0::DOUBLE * cos(el) * sin(az) * 1e6) AS BIGINT) AS cam_z FROM orbit")
def gen_camera_orbit(spark, sf):
    return generate.camera_orbit(spark).select("batch_id", *[ply.micro(F.col(f"cam_{a}")).alias(f"cam_{a}") for a in "xyz"])


@query(
    f"WITH {EMB}, {POSES}, c AS (SELECT idx, batch_id, x, y, z, cam_x - x AS dx, cam_y - y AS dy, cam_z - z AS dz FROM emb, poses) "
    "SELECT idx, batch_id FROM c WHERE (x * dx + y * dy + z * dz) / (sqrt(x * x + y * y + z * z) * sqrt(dx * dx + dy * dy + dz * dz)) > 0.15::DOUBLE"
)
def visible_points(spark, sf):
    return tsdf.visible_points(views.emb(spark, sf), views.poses(spark, sf)).select("idx", "batch_id")


# ---- streaming -------------------------------------------------------------------------------------------------------------


def _events(spark, sf):
    return incremental.read_stream(spark, f"{sf}/events.parquet", bytes_per_batch=incremental.BATCH_BYTES)


@query(f"WITH {_EV} SELECT kx, ky, kz, {KEY_SQL} AS key, count(*) AS cnt FROM v GROUP BY kx, ky, kz")
def stream_voxel(spark, sf):
    ev = views.event_points(_events(spark, sf))
    return incremental.run_available(incremental.stream_voxels(ev, EV_GRID))


@query(f"WITH {EV}, {POSES}, seen AS (SELECT ev.x, ev.y, ev.z, cam_x, cam_y, cam_z FROM ev JOIN poses p ON ev.batch_id % 25 = p.batch_id), {_samples('seen', 5.0, 15.0, 4)} SELECT kx, ky, kz, key, sum_dw, sum_w FROM field")
def stream_tsdf(spark, sf):
    ev = views.event_points(_events(spark, sf))
    seen = incremental.with_pose(ev, views.poses(spark, sf), lambda d: F.col("batch_id") % 25)
    return incremental.run_available(incremental.stream_tsdf(seen, WIDE))


@query(f"WITH {EV}, {_voxel(5.0, 'ev').join(('v AS (', ')'))} SELECT kx, ky, kz, {KEY_SQL} AS key, count(*) AS cnt FROM v GROUP BY kx, ky, kz")
def stream_voxel_blocks(spark, sf):
    """The state of keyed blocks, each dealt to four keys."""
    ev = views.event_points(_events(spark, sf)).withColumn("epoch", F.lit(0))
    return blocks.table(spark, blocks.run(blocks.voxel_rows(ev, EV_GRID, salts=4)), ["cnt"])


@query(f"WITH {EV}, w AS (SELECT * FROM ev WHERE idx // 4000 = (SELECT max(event_id) // 4000 FROM events)), {_voxel(5.0, 'w').join(('v AS (', ')'))} SELECT kx, ky, kz, {KEY_SQL} AS key, count(*) AS cnt FROM v GROUP BY kx, ky, kz")
def stream_voxel_reset(spark, sf):
    """Every 4000th event resets the grid, inside the running stream."""
    events = _events(spark, sf)
    ev = views.event_points(events).withColumn("epoch", F.floor(F.col("idx") / 4000).cast("long"))
    resets = events.where("event_id % 4000 = 0").select(F.floor(F.col("event_id") / 4000).cast("long").alias("epoch"))
    return blocks.table(spark, blocks.run(blocks.voxel_rows(ev, EV_GRID).unionByName(blocks.reset(resets))), ["cnt"])


@query(f"WITH {EV}, {POSES}, seen AS (SELECT ev.x, ev.y, ev.z, cam_x, cam_y, cam_z FROM ev JOIN poses p ON ev.batch_id % 25 = p.batch_id), {_samples('seen', 5.0, 15.0, 4)} SELECT kx, ky, kz, key, sum_dw, sum_w FROM field")
def stream_tsdf_blocks(spark, sf):
    ev = views.event_points(_events(spark, sf)).withColumn("epoch", F.lit(0))
    seen = incremental.with_pose(ev, views.poses(spark, sf), lambda d: F.col("batch_id") % 25)
    return blocks.table(spark, blocks.run(blocks.tsdf_rows(seen, WIDE)), ["sum_dw", "sum_w"])


# ---- kernels and reductions ------------------------------------------------------------------------------------------------


def _ints(spark, sf):
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("idx"), F.col("o_custkey").cast("long").alias("v"))


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def sum_serial(spark, sf):
    return kernels.sum_serial(_ints(spark, sf), "v")


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def sum_parallel(spark, sf):
    return kernels.sum_parallel(_ints(spark, sf), "v")


@query("SELECT CAST(o_orderkey AS BIGINT) AS idx, CAST(o_custkey AS BIGINT) * 3 + 7 AS w FROM orders")
def udf_map(spark, sf):
    return kernels.Kernel(spark).build(kernels.scaled).bind(_ints(spark, sf)).args(factor=3, shift=7).dispatch_elements("idx long, w long")


@query("SELECT CAST(o_orderkey AS BIGINT) AS idx, CAST(o_custkey AS BIGINT) * 3 + 7 AS w FROM orders")
def udf_sql(spark, sf):
    kernels.register_sql(spark)
    return _ints(spark, sf).select("idx", F.expr("scale_add(v, 3L, 7L)").alias("w"))


@query("SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(sum(CAST(l_orderkey AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def udaf_sum(spark, sf):
    return kernels.user_sum(views.table(spark, sf, "lineitem"), "l_linenumber", "l_orderkey").select(F.col("l_linenumber").cast("long").alias("l_linenumber"), "total")


@query("SELECT CAST(o_custkey AS BIGINT) AS g, CAST(o_orderkey AS BIGINT) AS idx, coalesce(v - lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS gap FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)")
def kernel_sql(spark, sf):
    """A user kernel over a partitioned table argument, called from SQL."""
    kernels.register_table_function(spark, "gaps", kernels.gaps, "g long, idx long, gap long")
    views.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("g"), F.col("o_orderkey").cast("long").alias("idx"), F.floor("o_totalprice").cast("long").alias("v")).createOrReplaceTempView("gaps_of_orders")
    return spark.sql("SELECT * FROM gaps(TABLE(gaps_of_orders) PARTITION BY g ORDER BY idx)")
