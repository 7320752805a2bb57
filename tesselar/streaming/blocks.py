"""Grids that grow with a stream, as keyed state: a block of 8 x 8 x 8 voxels is a key, its sums are one value.

Rows carry an ``epoch``, the number of resets before them. A reset is an input row like any other (``reset``), so it has its place in the
stream; a block forgets what it has when it sees a later epoch, and blocks that saw none since are left out when the state is read.
State may have a time to live, after which blocks without new rows go. A hot block can be dealt to several salted keys, as sums
add up when the state is read. ``table`` reads the state itself, through the state data source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tesselar.functions.morton import pack_key
from tesselar.operators.tsdf import SCALE, TSDF
from tesselar.operators.voxels import KEY, VoxelGrid
from tesselar.plans.scratch import folder

#: Edge of a block, as a power of two.
BITS = 3
SIZE = 1 << 3 * BITS
BLOCK = ("bx", "by", "bz", "salt")
#: Sums that a task holds before it hands them on, and rows it collects before it adds them up.
HELD = 1 << 18
#: The key of reset rows, and the store that keyed state needs.
CONTROL = -1
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(voxels: DataFrame, values: list, salts: int) -> DataFrame:
    """(bx, by, bz, salt, at, epoch, values) of rows (kx, ky, kz, epoch), added up in each task, so that the state meets a voxel once a task."""
    low = F.lit((1 << BITS) - 1)
    at = [F.col(k).bitwiseAND(low) for k in KEY]
    cell = F.shiftleft(at[0], 2 * BITS).bitwiseOR(F.shiftleft(at[1], BITS)).bitwiseOR(at[2]).cast("int")
    salt = F.pmod(F.xxhash64(*KEY, *values), F.lit(salts)).cast("long")
    rows = voxels.select(*[F.shiftright(k, BITS).alias(b) for k, b in zip(KEY, BLOCK)], salt.alias("salt"), cell.alias("at"), F.coalesce(F.col("epoch").cast("long"), F.lit(0)).alias("epoch"), *[v.alias(f"v{i}") for i, v in enumerate(values)])
    return rows.mapInArrow(_added(len(values)), rows.schema)


def _added(values: int):
    sums, keys = [f"v{i}" for i in range(values)], [*BLOCK, "at", "epoch"]

    def add(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        out = t.group_by(keys).aggregate([(v, "sum") for v in sums]).rename_columns({f"{v}_sum": v for v in sums})
        return out.select(t.column_names).cast(t.schema).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 2 * HELD:
                held = add(held)
                n = sum(h.num_rows for h in held)
                if n >= HELD:
                    yield from held
                    held, n = [], 0
        if n:
            yield from add(held)

    return run


def voxel_rows(cloud: DataFrame, grid: VoxelGrid, salts: int = 1) -> DataFrame:
    """Input of a count a voxel, from points (x, y, z, epoch)."""
    return _rows(grid.coords(cloud), [F.lit(1).cast("long")], salts)


def tsdf_rows(cloud: DataFrame, field: TSDF, salts: int = 1) -> DataFrame:
    """Input of a distance field, from points with a camera (x, y, z, cam_x, cam_y, cam_z, epoch)."""
    return _rows(field.samples(cloud, "epoch"), [F.col("dw"), F.lit(SCALE).cast("long")], salts)


def reset(events: DataFrame, values: int = 1) -> DataFrame:
    """Input rows that reset the state, from rows (epoch): what came before is forgotten."""
    zero = F.lit(0).cast("long")
    return events.select(*[zero.alias(b) for b in BLOCK[:3]], F.lit(CONTROL).cast("long").alias("salt"), F.lit(0).alias("at"), F.col("epoch").cast("long").alias("epoch"), *[zero.alias(f"v{i}") for i in range(values)])


class _Sums(StatefulProcessor):
    def __init__(self, values: int, ttl_ms: int | None):
        self.values, self.ttl = values, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "epoch long, " + ", ".join(f"v{i} array<long>" for i in range(self.values)), self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        epoch = held[0] if held else -1
        sums = np.array([list(v) for v in held[1:]], np.int64) if held else np.zeros((self.values, SIZE), np.int64)
        touched = np.zeros(SIZE, bool)
        for part in rows:
            epochs = part["epoch"].to_numpy()
            if epochs.max() > epoch:
                epoch = int(epochs.max())
                sums[:], touched[:] = 0, False
            now = epochs == epoch
            at = part["at"].to_numpy()[now]
            for i in range(self.values):
                np.add.at(sums[i], at, part[f"v{i}"].to_numpy()[now])
            touched[at] = True
        self.state.update((epoch, *(v.tolist() for v in sums)))
        at = np.flatnonzero(touched)
        yield pd.DataFrame({**{b: np.full(len(at), k, np.int64) for b, k in zip(BLOCK, key)}, "at": at.astype(np.int32), "epoch": np.full(len(at), epoch, np.int64), **{f"v{i}": sums[i][at] for i in range(self.values)}})

    def close(self) -> None:
        pass


def stream(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The voxels that each micro-batch changed, with their sums so far (of one salt)."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    values = sum(c.startswith("v") for c in rows.columns)
    schema = ", ".join([*(f"{b} long" for b in BLOCK), "at int", "epoch long", *(f"v{i} long" for i in range(values))])
    return rows.groupBy(*BLOCK).transformWithStateInPandas(_Sums(values, ttl_ms), schema, "Update", "ProcessingTime" if ttl_ms else "None")


def run(rows: DataFrame, checkpoint: str | None = None, ttl_ms: int | None = None, sink=None) -> str:
    """Processes all available input and returns the checkpoint, with which a later run goes on. ``sink(changed, number)`` gets what
    each micro-batch changed, and has to read all of it."""
    home = (checkpoint or folder(rows.sparkSession, "blocks")).rstrip("/")
    # with a time to live batches without data would follow for ever, so all input is one batch then
    trigger = {"once": True} if ttl_ms else {"availableNow": True}
    writer = stream(rows, ttl_ms).writeStream.outputMode("update").trigger(**trigger).option("checkpointLocation", home)
    (writer.foreachBatch(sink) if sink else writer.format("noop")).start().awaitTermination()
    return home


def table(spark: SparkSession, checkpoint: str, names: list[str]) -> DataFrame:
    """(kx, ky, kz, key, names) of the state that a checkpoint holds, of its last epoch; voxels nothing was added to have no row."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "sums").load()
    if "ttlExpirationMs" in state.schema["value"].dataType.names:  # what has expired is only removed when a batch comes
        state = state.where(F.col("value.ttlExpirationMs") > F.unix_millis(F.current_timestamp())).select("key", F.col("value.value").alias("value"))
    state = state.select(*[F.col(f"key.{b}").alias(b) for b in BLOCK], "value.*")
    last = F.broadcast(state.agg(F.max("epoch").alias("last")))  # one row
    cells = F.posexplode(F.arrays_zip(*[F.col(f"v{i}") for i in range(len(names))])).alias("at", "v")
    rows = state.where(F.col("salt") != CONTROL).crossJoin(last).where(F.col("epoch") == F.col("last")).select(*BLOCK[:3], cells)
    rows = rows.where(F.col(f"v.v{len(names) - 1}") != 0)  # the last value is a count or a weight
    low = (1 << BITS) - 1
    at = [F.shiftright("at", s).bitwiseAND(F.lit(low)).cast("long") for s in (2 * BITS, BITS, 0)]
    rows = rows.select(*[(F.shiftleft(b, BITS) + a).alias(k) for b, a, k in zip(BLOCK, at, KEY)], *[F.col(f"v.v{i}").alias(n) for i, n in enumerate(names)])
    out = rows.groupBy(*KEY).agg(*[F.sum(n).alias(n) for n in names])
    return out.select(*KEY, pack_key(*map(F.col, KEY)).alias("key"), *names)
