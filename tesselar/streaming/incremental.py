"""Occupancy and distance fields that grow with a stream of batches.

The state is Spark's: a grouped aggregate in the state store, in update mode. ``run_available`` processes what there is and
gives the state as a table, which executors write; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.operators.tsdf import TSDF
from tesselar.operators.voxels import KEY, VoxelGrid
from tesselar.plans.scratch import folder


#: Bytes of files that the queries take in a micro-batch.
BATCH_BYTES = 256 << 20


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1, bytes_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files under a path, or of the one file at it, with the schema they have now.

    With ``bytes_per_batch`` a micro-batch takes files up to that size together, at least one, so that the number of micro-batches,
    each of which writes the state it changed, goes with the bytes and not with the number of files."""
    limit = ("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else ("maxBytesPerTrigger", bytes_per_batch)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option(*limit)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    folder_, _, name = path.rpartition("/")  # file streams watch folders
    return reader.option("pathGlobFilter", name).parquet(folder_)


def stream_voxels(cloud: DataFrame, grid: VoxelGrid) -> DataFrame:
    return grid.count(cloud)


def stream_tsdf(cloud: DataFrame, field: TSDF) -> DataFrame:
    """``cloud`` brings its camera in each row, joined from a static table of poses before."""
    return field.integrate(cloud)


def run_available(state: DataFrame, checkpoint: str | None = None, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Runs a stateful query over all available input. With the checkpoint of an earlier run it goes on from there, also if nothing
    new has come; without one it starts empty, which is how the state is reset (``blocks`` has resets inside a running stream).

    A micro-batch writes only the rows it changed, into a folder of its own of one dataset beside the checkpoint; one that failed is
    written again under its number. At the end the last row of each key, of these and of the table of the run before, becomes the new
    table, which takes its name when it is whole; a failed run leaves the old one and is taken up by the next.
    """
    spark = state.sparkSession
    home = (checkpoint or folder(spark, "stream")).rstrip("/")
    out = f"{home}-state"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/_batch={number}")

    query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", home).foreachBatch(keep).start()
    query.awaitTermination()
    done = max(_numbers(spark, out, "table-"), default=-1)
    new = [n for n in _numbers(spark, f"{out}/changes", "_batch=") if n > done]
    if not new:
        return spark.read.schema(state.schema).parquet(f"{out}/table-{done}") if done >= 0 else spark.createDataFrame([], state.schema)
    changed = changes(spark, out, state.schema).where(F.col("_batch") > done)
    if done >= 0:
        changed = changed.unionByName(spark.read.schema(state.schema).parquet(f"{out}/table-{done}").withColumn("_batch", F.lit(done).cast("long")))
    rest = [c for c in state.columns if c not in keys]
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])
    path = f"{out}/table-{max(new)}"
    last.select(*state.columns).write.mode("overwrite").parquet(f"{path}.new")
    files, whole = _path(spark, path)
    if not files.rename(_path(spark, f"{path}.new")[1], whole):
        raise RuntimeError(f"could not name {path}")
    for number in _numbers(spark, f"{out}/changes", "_batch="):
        if number <= max(new):
            _drop(spark, f"{out}/changes/_batch={number}")
    for number in _numbers(spark, out, "table-"):  # the table before stays for those who still read it
        if number < done:
            _drop(spark, f"{out}/table-{number}")
    return spark.read.schema(state.schema).parquet(path)


def changes(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows that micro-batches changed, with their number: one dataset, however many there are."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])).option("basePath", f"{out}/changes").parquet(f"{out}/changes/_batch=*")


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, at: str, prefix: str) -> list[int]:
    """Numbers of the folders named by a prefix and a number."""
    files, path = _path(spark, at)
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def _drop(spark: SparkSession, at: str) -> None:
    files, path = _path(spark, at)
    files.delete(path, True)


def with_pose(cloud: DataFrame, poses: DataFrame, key: Callable[[DataFrame], F.Column]) -> DataFrame:
    """Adds the camera of each row's batch; how the poses are joined is up to their size."""
    return cloud.withColumn("_pose", key(cloud)).join(poses.withColumnRenamed("batch_id", "_pose"), "_pose").drop("_pose")
