import random
import re

import numpy as np
import pytest

from tesselar.operators import hierarchy, lbvh
from tesselar.operators.lbvh import SpatialIndex

from test_search import boxes_of, cloud, d2, rand


def files(df):
    """Files that a table's rows come from."""
    return {r[0] for r in df.selectExpr("_metadata.file_path").distinct().collect()}


@pytest.mark.parametrize("n", [2, 300])
def test_kept_index_is_opened_appended_and_compacted(spark, tmp_path, n):
    path, pts, more, qs = str(tmp_path / "index"), rand(n, n, 5), rand(40, 2, 9), rand(12, 3, 6)
    SpatialIndex.build(cloud(spark, pts), path=path)
    index = SpatialIndex.open(spark, path)
    assert index.length() == n

    def check(index, rows):
        got = {(x.q, x["rank"]): x.idx for x in index.knn_join(cloud(spark, qs), 4).collect()}
        want = {(i, k + 1): j for i, p in enumerate(qs) for k, (_, j) in enumerate(sorted((d2(a, p), j) for j, a in rows)[:4])}
        assert got == want
        near = {(x.q, x.idx) for x in index.radius_join(cloud(spark, qs), 3.0).collect()}
        assert near == {(i, j) for i, p in enumerate(qs) for j, a in rows if d2(a, p) <= 9}
        assert {x.idx for x in index.radius_search((1.0, 0.0, -1.0), 4.0).collect()} == {j for j, a in rows if d2(a, (1.0, 0.0, -1.0)) <= 16}
        assert [x.idx for x in index.knn((0.5, 0.0, 0.0), 3).orderBy("rank").collect()] == [j for _, j in sorted((d2(a, (0.5, 0.0, 0.0)), j) for j, a in rows)[:3]]

    rows = list(enumerate(pts))
    check(index, rows)
    index.append(cloud(spark, more).selectExpr("idx + 10000 as idx", "x", "y", "z"))
    rows += [(10000 + i, p) for i, p in enumerate(more)]
    for at in (index, SpatialIndex.open(spark, path)):
        assert len(at.runs) == 2 and at.length() == n + 40
        check(at, rows)
    index.compact()
    assert len(SpatialIndex.open(spark, path).runs) == 1
    check(SpatialIndex.open(spark, path), rows)


def test_append_compacts_past_the_bound_and_a_failed_append_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lbvh, "RUNS", 2)
    path = str(tmp_path / "index")
    index = SpatialIndex.build(cloud(spark, rand(30, 1, 1)), path=path)
    index.append(cloud(spark, rand(5, 2, 1)))
    before = SpatialIndex.open(spark, path)
    with monkeypatch.context() as broken:
        broken.setattr(SpatialIndex, "_publish", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            SpatialIndex.open(spark, path).append(cloud(spark, rand(7, 3, 1)).limit(7))
    assert SpatialIndex.open(spark, path).length() == before.length() == 35
    index = SpatialIndex.open(spark, path)
    index.append(cloud(spark, rand(7, 3, 1)))
    assert len(index.runs) == 1 and SpatialIndex.open(spark, path).length() == 42
    with pytest.raises(ValueError):
        SpatialIndex.open(spark, str(tmp_path))


def test_a_search_reads_few_files_of_a_kept_index(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        index = SpatialIndex.build(cloud(spark, rand(4000, 9, 50)), path=str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    run = index.runs[0]
    found = run.meeting((20.0, 20.0, 20.0), 3.0)
    assert len(run.ranges) >= 24 and len(found) * 4 <= len(run.ranges)
    leaves = spark.read.parquet(f"{run.path}/leaves")
    assert len(files(leaves.where(leaves["at"].isin(found)))) == len(found)
    plan = index.radius_search((20.0, 20.0, 20.0), 3.0)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*at#\d+ IN", plan) and re.search(r"PushedFilters: \[IsNotNull\(max_x", plan)


def test_a_radius_a_query(spark):
    pts, qs = rand(300, 5, 4), rand(30, 6, 4)
    radii = [0.0, 0.5, -1.0, 2.5, None, float("nan")] * 5
    q = spark.createDataFrame([(i, *p, r) for i, (p, r) in enumerate(zip(qs, radii))], "idx long, x double, y double, z double, r double")
    got = {(x.q, x.idx) for x in SpatialIndex.build(cloud(spark, pts)).radius_join(q, "r").collect()}
    assert got == {(i, j) for i, (p, r) in enumerate(zip(qs, radii)) if r is not None and r == r for j, a in enumerate(pts) if d2(a, p) <= r * r}


def test_equal_points_are_spread_over_tasks(spark):
    """Many equal primitives under many equal queries: no page has more than a few of either's rows."""
    index = SpatialIndex.build(spark.range(20_000).selectExpr("id as idx", "1.0D as x", "1.0D as y", "1.0D as z"))
    q = spark.range(3).selectExpr("id as idx", "1.0D as x", "1.0D as y", "1.0D as z")
    assert index.radius_join(q, 0.5).count() == 60_000
    pages = index.runs[0].pages(1)
    assert pages.where("n > 32").count() == 0 and pages.count() == 625


def by_hand(keys):
    """The nodes over sorted keys, top down: (first, last, split, level)."""
    out, todo = {}, [(0, len(keys) - 1)]
    while todo:
        a, b = todo.pop()
        if a == b:
            continue
        bit = (keys[a] ^ keys[b]).bit_length() - 1
        split = next(i for i in range(b, a - 1, -1) if not keys[i] >> bit & 1)
        out[a, b] = split, 62 - bit
        todo += [(a, split), (split + 1, b)]
    return out


@pytest.mark.parametrize("seed,size", [(1, 4), (3, 64)])
def test_linear_hierarchy_over_many_ranges(spark, monkeypatch, seed, size):
    """Ranges much smaller than nodes, taken together in several rounds, on dense, sparse and clustered keys."""
    monkeypatch.setattr(hierarchy, "RANGE", (size, size))
    monkeypatch.setattr(hierarchy, "TOGETHER", 3)
    r = random.Random(seed)
    keys = sorted({*(r.randrange(1 << 62) for _ in range(120)), *(r.randrange(1 << 12) for _ in range(150)), *((7 << 40) + i for i in range(90))})
    box = lambda i: tuple(float(v) for v in (i % 7, -i, i * i % 11, i % 7 + 1, i, i * i % 11))
    leaves = spark.createDataFrame([(i, k, *box(i)) for i, k in enumerate(keys)], "pos long, key long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    got = hierarchy.radix_nodes(leaves.repartition(5), len(keys)).collect()
    want = by_hand(keys)
    assert {(x.first_pos, x.last_pos): (x.split, x.level) for x in got} == want and len(got) == len(want)
    ids = {x.node_id: x for x in got}
    assert len(ids) == len(got) and (ids[0].first_pos, ids[0].last_pos) == (0, len(keys) - 1)
    for x in got:
        spans = [(c - len(keys) + 1,) * 2 if c >= len(keys) - 1 else (ids[c].first_pos, ids[c].last_pos) for c in (x.left_id, x.right_id)]
        assert spans == [(x.first_pos, x.split), (x.split + 1, x.last_pos)]
        inside = np.array([box(i) for i in range(x.first_pos, x.last_pos + 1)])
        assert [x.min_x, x.min_y, x.min_z] == inside[:, :3].min(0).tolist() and [x.max_x, x.max_y, x.max_z] == inside[:, 3:].max(0).tolist()


def test_hierarchy_of_boxes_after_appends(spark):
    r = random.Random(3)
    rows = [(i, *(lo := [r.uniform(-3, 3) for _ in range(3)]), *[v + r.random() for v in lo]) for i in range(50)]
    index = SpatialIndex.build(boxes_of(spark, rows[:30]), "boxes").append(boxes_of(spark, rows[30:])).compact()
    nodes = index.nodes().collect()
    assert len(nodes) == 99 and index.children().where("not covers").count() == 0
    assert sorted(x.prim_idx for x in nodes if x.is_leaf) == list(range(50))
