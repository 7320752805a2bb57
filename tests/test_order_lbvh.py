import random

import pytest

from tesselar.functions.morton import compact, spread
from tesselar.operators import order
from tesselar.operators.lbvh import SpatialIndex
from tesselar.schema import canonicalize, register_primitive
from pyspark.sql import functions as F

PT = "idx long, x double, y double, z double"
UNIT = [0.0, 0.0, 0.0, 1.0, 1.0, 1.0]


def boxes(spark, pts):
    return canonicalize(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], PT))


def bounds(spark, low, high):
    return spark.createDataFrame([(0, *[float(low)] * 3, *[float(high)] * 3)], "n long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")


def reference_code(p, low, high):
    out = 0
    q = [min(max(int((v - low) / max(high - low, 1e-8) * 1024), 0), 1023) for v in p]
    for b in range(10):
        for k, v in enumerate(q):
            out |= (v >> b & 1) << (3 * b + 2 - k)
    return out


def test_codes(spark):
    pts = [(0, 0, 0), (1, 1, 1), (0.3, 0.7, 0.2), (2, -1, 0.5)] + [(i / 8, 0, 0) for i in range(8)]
    got = {r.idx: r.code for r in order.morton_code(boxes(spark, pts), bounds(spark, 0, 1)).collect()}
    assert got[0] == 0 and got[1] == 0x3FFFFFFF
    assert got == {i: reference_code(p, 0, 1) for i, p in enumerate(pts)}
    back = order.morton_decode(order.morton_code(boxes(spark, pts[:3]), bounds(spark, 0, 1)).select("idx", "code")).collect()
    for r in back:
        assert all(abs(u - min(v, 1023 / 1024)) <= 1 / 1024 for u, v in zip((r.ux, r.uy, r.uz), pts[r.idx]))


def test_spread_compact(spark):
    assert spark.range(1024).where(compact(spread(F.col("id"))) != F.col("id")).count() == 0


def test_radix_sort_is_a_stable_sort(spark):
    r = random.Random(1)
    for codes in ([9, 4, 31, 2, 17, 4, 0, 12], [5] * 70, [3 * i for i in range(300)][::-1], [r.randrange(1 << 30) for _ in range(700)]):
        df = spark.createDataFrame([(i, c, i) for i, c in enumerate(codes)], "idx long, code long, pos long")
        want = [i for _, i in sorted((c, i) for i, c in enumerate(codes))]
        assert [x.idx for x in order.radix_sort(df, 8 if max(codes) >= 4096 else 3).orderBy("pos").collect()] == want
        assert [x.idx for x in order.morton_sort(df.drop("pos")).orderBy("pos").collect()] == want


@pytest.mark.parametrize("n,same", [(2, False), (64, False), (100, True), (257, False)])
def test_tree_is_valid(spark, n, same):
    r = random.Random(n)
    pts = [(0.5, 0.5, 0.5) if same else tuple(r.random() for _ in range(3)) for _ in range(n)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], PT)
    index = SpatialIndex.build(df)
    assert index.length() == n
    nodes = {x.node_id: x for x in index.nodes().collect()}
    assert len(nodes) == 2 * n - 1 and sorted(nodes) == list(range(2 * n - 1))
    leaves, seen, todo = [], set(), [0]
    while todo:
        i = todo.pop()
        assert i not in seen
        seen.add(i)
        x = nodes[i]
        if x.is_leaf:
            leaves.append(x.prim_idx)
        else:
            for c in (x.left_id, x.right_id):
                assert 1 <= c <= 2 * n - 2
                k = nodes[c]
                assert all(k[f"min_{a}"] >= x[f"min_{a}"] and k[f"max_{a}"] <= x[f"max_{a}"] for a in "xyz")
                todo.append(c)
    assert len(seen) == 2 * n - 1 and sorted(leaves) == list(range(n))
    assert index.children().where("not covers or n_children <> 2").count() == 0
    parents = {x.child_id: x.parent_id for x in index.parents().collect()}
    assert parents[0] == 0 and len(parents) == 2 * n - 1
    depth = {x.node_id: x.depth for x in index.depths().collect()}
    assert all(depth[c] == depth[p] + 1 for c, p in parents.items() if c)
    rel = {x.node_id: x for x in index.nodes(relative=True).where("not is_leaf").collect()}
    assert all(x.left_id + i == nodes[i].left_id for i, x in rel.items())


def test_too_few(spark):
    for n in (0, 1):
        with pytest.raises(ValueError):
            SpatialIndex.build(spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(n)], PT))


def test_registry(spark):
    tri = spark.createDataFrame([(7, [0.0, 5.0, 1.0], [2.0, -1.0, 0.0], [1.0, 1.0, 9.0]), (8, [0.0, None, 1.0], [2.0, -1.0, 0.0], [1.0, 1.0, 9.0])], "idx long, v0 array<double>, v1 array<double>, v2 array<double>")
    assert [tuple(r) for r in canonicalize(tri, "triangles").collect()] == [(7, 0.0, -1.0, 0.0, 2.0, 5.0, 9.0)]
    register_primitive("balls", lambda d: d.select("idx", *[(F.col(a) - F.col("r")).alias(f"min_{a}") for a in "xyz"], *[(F.col(a) + F.col("r")).alias(f"max_{a}") for a in "xyz"]))
    ball = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 0.5)], "idx long, x double, y double, z double, r double")
    assert tuple(canonicalize(ball, "balls").first()) == (1, -0.5, 0.5, 1.5, 0.5, 1.5, 2.5)
    with pytest.raises(ValueError):
        canonicalize(ball, "cones")
