import math
import random

import pytest
from pyspark.sql import functions as F

from tesselar.operators import packed, search, traverse
from tesselar.operators.lbvh import SpatialIndex
from tesselar.plans.scratch import save

PT = "idx long, x double, y double, z double"


def cloud(spark, pts):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], PT)


def rand(n, seed, extent):
    r = random.Random(seed)
    return [tuple(r.uniform(-extent, extent) for _ in range(3)) for _ in range(n)]


def d2(a, b):
    return sum((p - q) * (p - q) for p, q in zip(a, b))


CASES = [
    ([(4, -3, 7), (-9, 12, 2)], 6, set()),
    ([(0.2, 0.3, -0.1), (-0.4, 0.2, 0.3), (0.1, -0.5, 0.2)], 0.9, {0, 1, 2}),
    ([(1, 2, 2), (1, 2, 2.1), (-2, -2, -1), (0, 0, 3.5), (0, 3, 0)], 3, {0, 2, 4}),
    ([(0, 2.5 * i, 0) for i in range(1, 5)], 7.5, {0, 1, 2}),
    ([(0, 0, 0), (0, 0, 1e-9)], 0, {0}),
    ([(0, 0, 0), (0, -2, 0)], -1.5, {0}),
]


@pytest.mark.parametrize("pts,r,want", CASES)
def test_radius_golden(spark, pts, r, want):
    assert {x.idx for x in search.radius_search(cloud(spark, pts), (0, 0, 0), r).collect()} == want


def test_radius_random_and_monotone(spark):
    pts, c = rand(500, 42, 10), (1.0, -1.0, 0.5)
    df, last = cloud(spark, pts), -1
    for r in (0.5, 1.5, 3, 6, 20):
        got = {x.idx for x in search.radius_search(df, c, r).collect()}
        assert got == {i for i, p in enumerate(pts) if d2(p, c) <= r * r}
        assert len(got) >= last
        last = len(got)
        assert search.radius_count(df, c, r).first().n == len(got)


def test_knn(spark):
    pts = rand(200, 99, 5)
    df, c = cloud(spark, pts), (1.0, -1.0, 0.5)
    for k in (1, 5, 10, 20, 50, 64):
        want = [i for _, i in sorted((d2(p, c), i) for i, p in enumerate(pts))][:k]
        assert [x.idx for x in search.knn(df, c, k).orderBy("rank").collect()] == want
    assert search.knn(cloud(spark, pts[:3]), c, 10).count() == 3
    for k in (0, 65):
        with pytest.raises(ValueError):
            search.knn(df, c, k)


def test_joins_equal_brute_force(spark):
    pts, qs = rand(150, 7, 4), rand(40, 8, 4)
    qs += [qs[0], pts[3]]
    df, q = cloud(spark, pts), cloud(spark, qs)
    for r in (0.0, 0.7, 2.0):
        got = {(x.q, x.idx) for x in search.radius_join(q, df, r).collect()}
        assert got == {(i, j) for i, a in enumerate(qs) for j, b in enumerate(pts) if d2(a, b) <= r * r}
    got = {(x.q, x["rank"]): x.idx for x in search.knn_join(q, df, 4).collect()}
    for i, a in enumerate(qs):
        want = [j for _, j in sorted((d2(b, a), j) for j, b in enumerate(pts))][:4]
        assert [got[i, k] for k in range(1, 5)] == want


def test_knn_join_edges(spark):
    one = cloud(spark, [(1, 1, 1)] * 3)
    got = search.knn_join(one, one, 2).collect()
    assert sorted((x.q, x["rank"], x.idx) for x in got) == [(q, r, r - 1) for q in range(3) for r in (1, 2)]
    assert search.knn_join(one, one.where("false"), 2).count() == 0
    assert search.knn_join(one.where("false"), one, 2).count() == 0
    far = cloud(spark, [(0, 0, 0), (1e6, 0, 0)])
    assert search.knn_join(far, far, 5).count() == 4


def test_box_join_counts_pairs_once(spark):
    r = random.Random(5)
    boxes = [(i, *(lo := [r.uniform(-3, 3) for _ in range(3)]), *[v + r.uniform(0, 2) for v in lo]) for i in range(60)]
    b = spark.createDataFrame(boxes, "idx long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    qs = rand(30, 6, 4)
    got = [(x.q, x.idx) for x in search.radius_join(cloud(spark, qs), b, 0.6, "boxes").collect()]
    want = [(i, x[0]) for i, p in enumerate(qs) for x in boxes if sum(max(0, x[1 + a] - p[a], p[a] - x[4 + a]) ** 2 for a in range(3)) <= 0.36]
    assert sorted(got) == sorted(want)


def test_bad_rows_are_dropped(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, math.nan, 0.0, 0.0), (2, None, 0.0, 0.0), (3, math.inf, 0.0, 0.0)], PT).withColumn("dist2", F.lit("clash"))
    assert [x.idx for x in search.radius_search(df, (0, 0, 0), 1).collect()] == [0]
    assert search.radius_search(df.where("false"), (0, 0, 0), 1).count() == 0


def test_box_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    cloud(spark, rand(50, 1, 5)).write.parquet(path)
    plan = search.radius_search(spark.read.parquet(path), (0, 0, 0), 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x" in plan and "LessThanOrEqual(x" in plan


def boxes_of(spark, rows):
    return spark.createDataFrame(rows, "idx long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")


def box_d2(p, x):
    d = [max(0.0, x[1 + a] - p[a], p[a] - x[4 + a]) for a in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def test_knn_join_of_boxes_and_triangles(spark):
    r = random.Random(15)
    rows = [(i, *(lo := [r.uniform(-3, 3) for _ in range(3)]), *[v + r.choice((0, 0.1, 1.0, 4.0)) * r.random() for v in lo]) for i in range(80)]
    qs = rand(25, 16, 5) + [(900.0, 0.0, 0.0)]
    for k in (1, 6, 64):
        got = {(x.q, x["rank"]): x.idx for x in search.knn_join(cloud(spark, qs), boxes_of(spark, rows), k, "boxes").collect()}
        want = {(i, n + 1): j for i, p in enumerate(qs) for n, (_, j) in enumerate(sorted((box_d2(p, x), x[0]) for x in rows)[:k])}
        assert got == want
    tri = spark.createDataFrame([(i, [float(i), 0.0, 0.0], [i + 0.5, 1.0, 0.0], [float(i), 0.0, 1.0]) for i in range(9)], "idx long, v0 array<double>, v1 array<double>, v2 array<double>")
    got = search.knn_join(cloud(spark, [(4.1, 0.5, 0.5), (-3, 0, 0)]), tri, 2, "triangles").collect()
    assert sorted((x.q, x["rank"], x.idx) for x in got) == [(0, 1, 4), (0, 2, 3), (1, 1, 0), (1, 2, 1)]


def candidates(index, qs, k):
    """Leaves that a k-nearest search compares with its queries: on its dive, and after it."""
    q = search.points(qs).selectExpr("idx as q", "x as qx", "y as qy", "z as qz")
    dive = traverse._leaves(index, traverse._descend(index, q, traverse.dive(k))).count()
    return dive + traverse._leaves(index, traverse._descend(index, traverse.bounds(index, q, k), traverse.within)).count()


@pytest.mark.parametrize("n", [1000, 4000])
def test_one_far_point_leaves_few_candidates(spark, n):
    r = random.Random(n)
    pts = [tuple(r.random() for _ in range(3)) for _ in range(n)] + [(1e5, 0.0, 0.0)]
    df, k = cloud(spark, pts), 5
    assert candidates(SpatialIndex.build(df), df, k) < 100 * k * len(pts)
    got = search.knn_join(df, df, k).where("q % 97 = 0").collect()
    assert {x.q for x in got} >= {0, 97, 194}
    for i in {x.q for x in got}:
        want = [j for _, j in sorted((d2(p, pts[i]), j) for j, p in enumerate(pts))][:k]
        assert [x.idx for x in sorted(got, key=lambda x: x["rank"]) if x.q == i] == want


def test_duplicates_and_far_queries_have_few_candidates(spark):
    """Equal primitives, and queries far from all: a few pages a query, and not many more for four times the primitives."""
    k, page, seen = 5, 32, []
    for n in (1500, 6000):
        same = cloud(spark, [(1, 2, 3)] * n)
        index = SpatialIndex.build(same)
        assert candidates(index, same.where("idx in (0, 49, 1451)"), k) <= 3 * 6 * page
        got = index.knn_join(same.where("idx < 50"), k)
        assert got.where("rank <> idx + 1 or dist2 <> 0").count() == 0 and got.count() == 50 * k
        r = random.Random(n)
        cluster = cloud(spark, [tuple(r.random() for _ in range(3)) for _ in range(n)])
        far = cloud(spark, [(1e4 + 50 * i, -3e4, 7.0 * i) for i in range(40)])
        seen.append(candidates(SpatialIndex.build(cluster), far, k))
    assert seen[1] <= 40 * 16 * page and seen[1] < 2 * seen[0]


def test_one_large_box_is_in_few_pages(spark):
    rows = [(0, -1e4, -1e4, -1e4, 1e4, 1e4, 1e4)] + [(i, i / 10, 0.0, 0.0, i / 10 + 0.01, 0.01, 0.01) for i in range(1, 200)]
    qs = [(x / 7, 0.05, 0.0) for x in range(60)]
    b, q = boxes_of(spark, rows), cloud(spark, qs)
    index = SpatialIndex.build(b, "boxes")
    asked = search.points(q).selectExpr("idx as q", "x as qx", "y as qy", "z as qz", "0.01D as b2")
    front = traverse._descend(index, asked, lambda rows: rows.where(traverse.nearest([F.col("qx"), F.col("qy"), F.col("qz")]) <= F.col("b2")))
    assert traverse._leaves(index, front).count() <= 60 * 5 * 32  # few of the pages that have the large box or lie near
    got = sorted((x.q, x.idx) for x in search.radius_join(q, b, 0.1, "boxes").collect())
    assert got == sorted((i, x[0]) for i, p in enumerate(qs) for x in rows if box_d2(p, x) <= 0.1 * 0.1)


def asked_rows(monkeypatch):
    """Counts of the (query block, block) rows that joins send, one a tier."""
    seen, real = [], packed._asked

    def asked(*args):
        out = save(real(*args))
        seen.append(out.count())
        return out

    monkeypatch.setattr(packed, "_asked", asked)
    return seen


def test_overlapping_boxes_are_met_by_their_ids(spark, monkeypatch):
    """Thousands of boxes at one distance from a query, in space in another order than their ids: the lowest ids are found without the other tier."""
    seen, r = asked_rows(monkeypatch), random.Random(4)
    rows = [(i, *[-r.uniform(0.01, 9) for _ in range(3)], *[r.uniform(0.01, 9) for _ in range(3)]) for i in range(6000)]
    r.shuffle(rows)
    qs = [(r.uniform(-2, 2), r.uniform(-2, 2), x) for x in (0.0, 1.5, 12.0) for _ in range(30)]
    got = {(x.q, x["rank"]): (x.idx, x.dist2) for x in search.knn_join(cloud(spark, qs[:60]), boxes_of(spark, rows), 3, "boxes").collect()}
    assert seen[0] > 0 and seen[1] == 0
    got |= {(x.q + 60, x["rank"]): (x.idx, x.dist2) for x in search.knn_join(cloud(spark, qs[60:]), boxes_of(spark, rows), 3, "boxes").collect()}
    assert got == {(i, n + 1): (j, d) for i, p in enumerate(qs) for n, (d, j) in enumerate(sorted((box_d2(p, x), x[0]) for x in rows)[:3])}


def test_joins_send_few_rows(spark, monkeypatch):
    """Dense points under all of themselves: rows for pairs of blocks, not of queries and pages; far blocks are never sent."""
    seen, r = asked_rows(monkeypatch), random.Random(6)
    pts = [(r.random() + 100 * (i % 2), r.random(), r.random()) for i in range(8000)]
    got = search.radius_join(cloud(spark, pts), cloud(spark, pts), 0.05)
    want = sum(d2(pts[i], b) <= 0.05 * 0.05 for i in range(0, 8000, 100) for b in pts)
    assert got.where("q % 100 = 0").count() == want and 0 < seen[0] <= 32


def test_radius_joins_shuffle_names_only(spark, monkeypatch):
    """However many pairs of blocks there are, no coordinates go with a pair: tasks read the blocks, whatever the kind of ids, each query with its radius."""
    r = random.Random(8)
    rows = [(i, *(a - 0.01 for a in p), *(a + 0.01 for a in p)) for i, p in enumerate((r.random(), r.random(), r.random()) for _ in range(5000))]
    qs = [(f"q{i}", r.random(), r.random(), r.random(), 0.02 * (i % 3)) for i in range(4500)]
    b, q = boxes_of(spark, rows), spark.createDataFrame(qs, "idx string, x double, y double, z double, r double")
    seen = asked_rows(monkeypatch)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.radius_join(q, b, "r", "boxes")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((x.q, x.idx, x.dist2) for x in found.where("q like '%7'").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((i, x[0], d) for i, *p, w in qs if i.endswith("7") for x in rows if (d := box_d2(p, x)) <= w * w) and len(got) > 100
    assert seen[0] > 4 and "Join" not in plan and plan.count("Exchange") == 1 and "binary" not in plan
