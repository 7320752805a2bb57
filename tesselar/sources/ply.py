"""PLY sink: a Spark data source whose tasks write parts to the target's folder and whose commit joins them into one file.

``df.write.format("ply").option("kind", "mesh" | "points").mode("overwrite").save(uri)`` after ``register(spark)``.
Rows are written in the order of the DataFrame's partitions. Meshes are un-indexed: faces count up the vertices.
"""

from __future__ import annotations

import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tesselar.operators.voxels import VoxelGrid
from tesselar.plans.scratch import with_position


def _number(v: float) -> str:
    """Six significant digits, as C++ streams write by default."""
    return f"{v:.6g}"


@dataclass
class _Part(WriterCommitMessage):
    index: int
    path: str
    rows: int


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, [f.name for f in schema.fields])


class _Writer(DataSourceWriter):
    def __init__(self, options, names: list[str]):
        self.target, self.mesh = options["path"], options.get("kind", "mesh") == "mesh"
        self.cols = [f"{a}{i}" for i in range(3) for a in "xyz"] if self.mesh else list("xyz")
        missing = [c for c in self.cols if c not in names]
        if missing:
            raise ValueError(f"a PLY {'mesh' if self.mesh else 'point cloud'} needs the columns {missing}")
        self.job = uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs

        uri = self.target if "://" in self.target else "file://" + self.target.removeprefix("file:")
        return fs.FileSystem.from_uri(uri)

    def write(self, rows) -> _Part:
        from pyspark import TaskContext

        fs, target = self._fs()
        fs.create_dir(target.rpartition("/")[0], recursive=True)
        index = TaskContext.get().partitionId()
        path, n = f"{target}.{self.job}.{index}.{uuid.uuid4().hex}", 0
        with fs.open_output_stream(path) as out:
            for row in rows:
                v = [_number(row[c]) for c in self.cols]
                out.write("".join(" ".join(v[i : i + 3]) + "\n" for i in range(0, len(v), 3)).encode())
                n += 1
        return _Part(index, path, n)

    def commit(self, messages) -> None:
        fs, target = self._fs()
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.index)
        n = sum(p.rows for p in parts)
        head = f"ply\nformat ascii 1.0\nelement vertex {n * 3 if self.mesh else n}\nproperty float x\nproperty float y\nproperty float z\n"
        if self.mesh:
            head += f"element face {n}\nproperty list uchar int vertex_indices\n"
        temp = f"{target}.{self.job}"
        with fs.open_output_stream(temp) as out:
            out.write((head + "end_header\n").encode())
            for p in parts:
                with fs.open_input_stream(p.path) as part:
                    shutil.copyfileobj(part, out, 1 << 20)
            if self.mesh:
                for k in range(0, n, 10_000):
                    out.write("".join(f"3 {3 * i} {3 * i + 1} {3 * i + 2}\n" for i in range(k, min(n, k + 10_000))).encode())
        fs.move(temp, target)
        self._drop(fs, parts)

    def abort(self, messages) -> None:
        fs, _ = self._fs()
        self._drop(fs, [m for m in messages if m is not None])

    @staticmethod
    def _drop(fs, parts) -> None:
        for p in parts:
            fs.delete_file(p.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def write_mesh(triangles: DataFrame, uri: str) -> None:
    register(triangles.sparkSession)
    triangles.write.format("ply").option("kind", "mesh").mode("overwrite").save(uri)


def write_points(points: DataFrame, uri: str) -> None:
    register(points.sparkSession)
    points.write.format("ply").option("kind", "points").mode("overwrite").save(uri)


def write_centers(voxels: DataFrame, grid: VoxelGrid, uri: str) -> None:
    """The middles of occupied voxels, or of those of a distance field, as a point cloud."""
    write_points(grid.centers(voxels), uri)


def micro(col) -> F.Column:
    return F.round(col * 1e6).cast("long")


def mesh_lines(triangles: DataFrame) -> DataFrame:
    """The file's body as a table (line_no, kind, a, b, c): vertices in millionths, then faces."""
    rows = with_position(triangles, "ax", "ay", "az", "tri", name="t")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), *[micro(F.col(f"{a}{i}")).alias(b) for a, b in zip("xyz", "abc")]) for i in range(3)])
    vertex = rows.select("t", F.explode(corners).alias("v")).select((F.col("t") * 3 + F.col("v.i")).alias("line_no"), F.lit("vertex").alias("kind"), "v.a", "v.b", "v.c")
    face = rows.select("t").crossJoin(F.broadcast(n)).select((F.col("n") * 3 + F.col("t")).alias("line_no"), F.lit("face").alias("kind"), *[(F.col("t") * 3 + i).alias(b) for i, b in enumerate("abc")])
    return vertex.unionByName(face)


def point_lines(points: DataFrame) -> DataFrame:
    """(line_no, a, b, c) of a point cloud in the order of idx, in millionths."""
    rows = with_position(points, "idx", name="line_no")
    return rows.select("line_no", *[micro(F.col(a)).alias(b) for a, b in zip("xyz", "abc")])
