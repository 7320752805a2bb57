import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesselar.operators import tsdf, voxels
from tesselar.plans import registry
from tesselar.streaming import blocks, incremental

ROW = "idx long, x double, y double, z double, epoch long"
GRID = voxels.VoxelGrid(1.0)


def put(spark, path, rows, schema=ROW):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def counts(rows, epoch):
    return Counter((int(x // 1), int(y // 1), int(z // 1)) for _, x, y, z, e in rows if e == epoch)


def table(spark, at):
    rows = blocks.table(spark, at, ["cnt"]).collect()
    got = {(r.kx, r.ky, r.kz): r.cnt for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("salts", [1, 3])
def test_reset_inside_a_running_stream(spark, tmp_path, salts):
    """Points, a reset, points: in several micro-batches and over a restart. What came before the reset is gone everywhere."""
    src, check, r = str(tmp_path / "in"), str(tmp_path / "check"), random.Random(salts)
    rows, seen = [], []

    def more(epoch, n=60):
        new = [(i, r.uniform(-20, 20), r.uniform(-20, 20), r.choice((0.5, -0.5)), epoch) for i in range(n)]
        put(spark, src, new)
        rows.extend(new)

    def run():
        cloud = incremental.read_stream(spark, src)
        points = blocks.voxel_rows(cloud.where("x is not null"), GRID, salts)
        at = blocks.run(points.unionByName(blocks.reset(cloud.where("x is null"))), check, sink=lambda df, n: seen.append((n, len(df.collect()))))
        return table(spark, at)

    more(0), more(0)
    assert run() == counts(rows, 0)
    more(0)
    put(spark, src, [(0, None, None, None, 1)])
    assert run() == {} and len({n for n, _ in seen}) == 4
    more(1), more(0)  # late rows of the epoch before are dropped
    assert run() == counts(rows, 1)
    assert run() == counts(rows, 1)  # nothing new


def test_changed_voxels_come_out_of_each_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, [(i, float(i % 3), 0.0, 0.0, 0) for i in range(9)])
    put(spark, src, [(i, 1.0, 0.0, 0.0, 0) for i in range(2)])
    out = []
    rows = blocks.voxel_rows(incremental.read_stream(spark, src), GRID)
    blocks.run(rows, sink=lambda df, n: out.append(sorted((r["at"] >> 6, r.v0) for r in df.collect())))
    assert sorted(map(tuple, out), key=len) in ([((1, 2),), ((0, 3), (1, 5), (2, 3))], [((1, 5),), ((0, 3), (1, 3), (2, 3))])


def test_state_has_a_time_to_live(spark, tmp_path):
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    rows = lambda: blocks.voxel_rows(incremental.read_stream(spark, src), GRID)
    put(spark, src, [(0, 5.0, 0.0, 0.0, 0)])
    blocks.run(rows(), check, ttl_ms=60_000)
    assert table(spark, check) == {(5, 0, 0): 1}
    src, check = str(tmp_path / "again"), str(tmp_path / "short")
    put(spark, src, [(0, 5.0, 0.0, 0.0, 0)])
    blocks.run(rows(), check, ttl_ms=1)
    time.sleep(0.1)
    assert table(spark, check) == {}
    put(spark, src, [(1, 5.0, 0.0, 0.0, 0), (2, 50.0, 0.0, 0.0, 0)])
    changed = []
    blocks.run(rows(), check, ttl_ms=1, sink=lambda df, n: changed.extend((r.bx, r.v0) for r in df.collect()))
    assert sorted(changed) == [(0, 1), (6, 1)]  # the first point's block had gone


def test_field_of_blocks_equals_the_batch(spark, tmp_path):
    src, r = str(tmp_path / "in"), random.Random(4)
    field = tsdf.TSDF(0.5, 1.5)
    schema = "x double, y double, z double, cam_x double, cam_y double, cam_z double, epoch long"
    for _ in range(3):
        put(spark, src, [(r.uniform(-9, 9), r.uniform(-9, 9), 0.3, 0.0, 0.0, 4.0, 0) for _ in range(40)], schema)
    at = blocks.run(blocks.tsdf_rows(incremental.read_stream(spark, src), field, salts=2))
    got = blocks.table(spark, at, ["sum_dw", "sum_w"])
    want = field.integrate(spark.read.parquet(src))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count() > 100


def test_changes_are_one_dataset(spark, tmp_path, monkeypatch):
    """However many micro-batches there were, one relation reads what they changed; a table without its marker is still seen."""
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    for k in range(5):
        put(spark, src, [(i, float(i % (k + 1)), 0.0, 0.0, 0) for i in range(10)])
    read, plans = incremental.changes, []

    def watched(*a):
        df = read(*a)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        assert df.select("_batch").distinct().count() == 5
        return df

    monkeypatch.setattr(incremental, "changes", watched)
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        state = lambda: incremental.stream_voxels(incremental.read_stream(spark, src), GRID)
        got = {(r.kx, r.cnt) for r in incremental.run_available(state(), check).collect()}
        assert got == {(r.kx, r.cnt) for r in GRID.count(spark.read.parquet(src)).collect()}
        assert plans[0].count("FileScan") == 1
        assert {(r.kx, r.cnt) for r in incremental.run_available(state(), check).collect()} == got
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_poses_are_joined_by_their_size(spark, monkeypatch):
    pts = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, -1.0, 0.0, 0.0)], "idx long, x double, y double, z double")
    poses = spark.createDataFrame([(0, 3.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0)], "batch_id long, cam_x double, cam_y double, cam_z double")
    want = [(0, 0), (0, 1)]
    assert sorted((r.idx, r.batch_id) for r in tsdf.visible_points(pts, poses).collect()) == want
    monkeypatch.setattr(tsdf, "FEW", 1)
    assert sorted((r.idx, r.batch_id) for r in tsdf.visible_points(pts, poses).collect()) == want
    assert tsdf.visible_points(pts, poses.where(F.lit(False))).count() == 0


def test_rows_of_a_voxel_are_added_up_before_the_state(spark):
    """A task hands on a row a voxel, salt and epoch, with the sums of all its rows; more voxels than it holds are all there."""
    cloud = spark.range(0, 700_000, 1, 2).selectExpr("id % 40 + 0.5D as x", "0.5D as y", "0.5D as z", "id % 2 as epoch")
    rows = blocks.voxel_rows(cloud, GRID)
    assert rows.count() == 2 * 40 and rows.agg(F.sum("v0")).first()[0] == 700_000
    assert {r.n for r in rows.groupBy("bx", "at", "epoch").agg(F.sum("v0").alias("n")).collect()} == {17_500}
    wide = blocks.voxel_rows(spark.range(0, 600_000, 1, 1).selectExpr("CAST(id AS DOUBLE) as x", "0.5D as y", "0.5D as z", "0 as epoch"), GRID)
    assert wide.count() == 600_000 and wide.agg(F.sum("v0")).first()[0] == 600_000


@pytest.mark.parametrize("name", ["stream_tsdf", "stream_voxel"])
def test_many_small_files_are_few_batches(spark, sf, tmp_path, monkeypatch, name):
    """The queries' micro-batches go with the bytes, not with the number of files; however many there are, the result is the same."""
    os.symlink(f"{sf}/nation.parquet", tmp_path / "nation.parquet")
    spark.read.parquet(f"{sf}/events.parquet").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    read, batches = incremental.changes, []

    def watched(*a):
        df = read(*a)
        batches.append(df.select("_batch").distinct().count())
        return df

    monkeypatch.setattr(incremental, "changes", watched)
    rows = lambda d: sorted(map(tuple, registry.QUERIES[name](spark, d).collect()))
    got = rows(str(tmp_path))
    monkeypatch.setattr(incremental, "BATCH_BYTES", 1)
    assert got == rows(sf) == rows(str(tmp_path)) and len(got) > 100
    assert batches == [1, 1, 6]


@pytest.mark.parametrize("name", ["stream_tsdf", "stream_tsdf_blocks"])
def test_an_event_at_its_camera_adds_nothing(spark, sf, tmp_path, name):
    """Its ray has no direction: the event is dropped and no division by its depth of 0 ends the stream."""
    os.symlink(f"{sf}/nation.parquet", tmp_path / "nation.parquet")
    events = spark.read.parquet(f"{sf}/events.parquet")
    at = events.where("event_id = 0").withColumn("event_id", F.lit(18_003).cast("long")).withColumn("user_id", F.lit(1).cast("long")).withColumn("value", F.lit(1.0))  # batch 18 is seen from (1, 1, 3)
    events.unionByName(at).write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda d: sorted(map(tuple, registry.QUERIES[name](spark, d).collect()))
    assert rows(str(tmp_path)) == rows(sf)
