import math
from collections import Counter

from pyspark.sql import functions as F

from tesselar.operators import marching, tsdf, voxels
from tesselar.sources import generate, ply
from tesselar.streaming import incremental

PT = "idx long, x double, y double, z double"


def test_tables():
    t = marching.triangulation()
    assert len(t) == 256 and sum(map(len, t)) == 820 and not t[0] and not t[255]
    for case, triangles in enumerate(t):
        used = 0
        for tri in triangles:
            for e in tri:
                used |= 1 << e
        assert used == marching.cut_edges(case)


def edges_close(triangles):
    """Each directed edge of a closed mesh has its reverse."""
    count = Counter()
    for r in triangles:
        v = [tuple(round(r[f"{a}{i}"], 6) for a in "xyz") for i in range(3)]
        for i in range(3):
            count[v[i], v[(i + 1) % 3]] += 1
    return all(count[a, b] == count[b, a] for a, b in count)


def volume(triangles):
    out = 0
    for r in triangles:
        a, b, c = ([r[f"{x}{i}"] for x in "xyz"] for i in range(3))
        out += a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return out / 6


def test_occupancy_mesh_closes(spark):
    import random

    r = random.Random(3)
    vox = spark.createDataFrame([(r.randrange(6), r.randrange(6), r.randrange(6)) for _ in range(90)], "kx long, ky long, kz long").distinct()
    mesh = marching.mesh(vox, 1.0).collect()
    assert mesh and edges_close(mesh) and volume(mesh) > 0
    assert marching.triangle_count(marching.cubes(vox)).first().n == len(mesh)
    ordered = sorted((m.ax, m.ay, m.az, m.tri) for m in mesh)
    assert [(m.ax, m.ay, m.az, m.tri) for m in marching.limit(marching.mesh(vox, 1.0), 5).collect()] == ordered[:5]


def sphere(spark, size):
    pts = generate.shell_grid(spark, 1.0, size, size / 2)
    seen = tsdf.visible_points(pts, generate.camera_orbit(spark, 5, 12)).drop("batch_id")
    return tsdf.TSDF(size, 3 * size), seen


def test_sphere_field(spark):
    error = []
    for size in (0.2, 0.1):
        kind, seen = sphere(spark, size)
        field = kind.integrate(seen)
        mesh = marching.tsdf_mesh(field, size).collect()
        assert edges_close(mesh)
        assert field.where("sum_w < 10000").count() == 0
        assert kind.filled_count(seen).first().n == field.count()
        error.append(abs(volume(mesh) / (4 / 3 * math.pi) - 1))
    assert error[1] < error[0] and error[1] < 0.1  # smaller voxels come closer to the sphere


def test_generators(spark):
    assert abs(generate.ball_grid(spark).count() - 4163) < 20
    assert abs(generate.shell_grid(spark).count() - 10162) < 200
    assert generate.camera_orbit(spark).count() == 324
    assert generate.random_boxes(spark, 50).where("min_x > max_x or min_z > max_z").count() == 0


def test_voxels(spark):
    pts = [(0, -0.05, 0.0, 0.1), (1, 0.05, 0.0, 0.1), (2, 0.05, 0.09, 0.19), (3, None, 0.0, 0.0)]
    grid = voxels.VoxelGrid(0.1)
    df = spark.createDataFrame(pts, PT)
    got = {(r.kx, r.ky, r.kz): r.cnt for r in grid.count(df).collect()}
    assert got == {(-1, 0, 1): 1, (0, 0, 1): 2}
    assert grid.filled_count(df).first().n == 2
    keys = voxels.keys(spark.createDataFrame([(-512, 511, 0), (-1, 2, 3)], "kx long, ky long, kz long"))
    assert keys.where("kx <> ux or ky <> uy or kz <> uz").count() == 0
    far = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 102.4, 0.0, 0.0)], PT)
    assert grid.count(far).count() == 2  # 1024 voxels apart: one key, two voxels
    capped = voxels.cap_batches(df.withColumn("batch_id", F.lit(1)), 2)
    assert sorted(r.idx for r in capped.collect()) == [0, 1]


def test_degenerate_ray(spark):
    cams = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "x double, y double, z double, cam_x double, cam_y double, cam_z double")
    assert tsdf.TSDF().integrate(cams.limit(1)).count() == 0
    assert tsdf.TSDF().integrate(cams.where("false")).count() == 0


def test_ply(spark, tmp_path):
    vox = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "kx long, ky long, kz long")
    path = tmp_path / "m.ply"
    ply.write_mesh(marching.mesh(vox, 0.1), str(path))
    text = path.read_text().split("\n")
    n = marching.mesh(vox, 0.1).count()
    assert text[:3] == ["ply", "format ascii 1.0", f"element vertex {3 * n}"] and f"element face {n}" in text
    body = text[text.index("end_header") + 1 : -1]
    assert len(body) == 4 * n and body[-1] == f"3 {3 * n - 3} {3 * n - 2} {3 * n - 1}"
    assert list(tmp_path.iterdir()) == [path]
    pts = tmp_path / "p.ply"
    ply.write_points(spark.createDataFrame([(1 / 3, 2.0, -1e-7)], "x double, y double, z double"), str(pts))
    assert pts.read_text().split("\n")[-2] == "0.333333 2 -1e-07"


def test_stream_goes_on_and_resets(spark, tmp_path):
    grid, src = voxels.VoxelGrid(1.0), str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(i, float(i % (2 + k)), 0.0, 0.0) for i in range(10)], PT).coalesce(1).write.mode("append").parquet(src)
    batch = {(r.kx, r.cnt) for r in grid.count(spark.read.parquet(src)).collect()}
    check = str(tmp_path / "check")
    state = lambda: incremental.stream_voxels(incremental.read_stream(spark, src), grid)
    assert {(r.kx, r.cnt) for r in incremental.run_available(state(), check).collect()} == batch
    spark.createDataFrame([(0, 50.0, 0.0, 0.0)], PT).coalesce(1).write.mode("append").parquet(src)
    assert {(r.kx, r.cnt) for r in incremental.run_available(state(), check).collect()} == batch | {(50, 1)}
    again = incremental.run_available(state(), check)  # nothing new
    assert {(r.kx, r.cnt) for r in again.collect()} == batch | {(50, 1)} and again.count() == len(batch) + 1
    assert {(r.kx, r.cnt) for r in incremental.run_available(state()).collect()} == batch | {(50, 1)}


def test_centres_are_exported(spark, tmp_path):
    grid = voxels.VoxelGrid(0.5)
    vox = grid.count(spark.createDataFrame([(0, 0.1, 0.6, -0.2), (1, 0.2, 0.7, -0.3), (2, 3.0, 0.0, 0.0)], PT))
    path = tmp_path / "c.ply"
    ply.write_centers(vox, grid, str(path))
    text = path.read_text().split("\n")
    assert "element vertex 2" in text and sorted(text[text.index("end_header") + 1 : -1]) == ["0.25 0.75 -0.25", "3.25 0.25 0.25"]


def test_halo_is_small_and_blocks_do_not_show(spark):
    """A dense grid over several blocks and both signs: few more rows than voxels, and the cubes of plain Python."""
    full = {(x, y, z) for x in range(-9, 10) for y in range(-3, 17) for z in range(-17, 1) if (x * 7 + y * 5 + z * 3) % 11}
    vox = spark.createDataFrame(sorted(full), "kx long, ky long, kz long").repartition(5)
    assert marching.halo_rows(vox).count() < 1.6 * len(full)
    want = {}
    for v in full:
        for c, o in enumerate(marching.CORNERS):
            a = tuple(p - q for p, q in zip(v, o))
            want[a] = want.get(a, 0) | 1 << c
    assert {(r.ax, r.ay, r.az): r.ci for r in marching.cubes(vox).collect()} == {a: ci for a, ci in want.items() if ci != 255}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # blocks that go on over batches
    try:
        assert marching.cubes(vox).count() == sum(ci != 255 for ci in want.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert marching.cubes(vox.where("false")).count() == 0
