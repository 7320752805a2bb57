"""A spatial index: primitives in Morton order, written once, with boxes of pages and pages of pages, and the binary hierarchy as tables.

The written index is what queries read. Leaves are sorted by a Morton code of 40 bits an axis, so that neither an outlier nor a dense spot
leaves pages that are spread out, and lie in sorted runs, a folder a range of each run (``at``), so that queries read only the ranges
they can meet. FAN leaves make a page, FAN pages a page of the next level, up to TOP pages; ``traverse`` walks down these levels. A
batch appended later is a run of its own, searched together with the others, until ``compact`` sorts all runs into one.

The binary hierarchy (``internal_nodes`` and what follows) is that of the keys ``code << 32 | position``, with the code of 10 bits an axis
and positions in the order of (code, idx). Either is made when it is first asked for.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tesselar.operators import packed, traverse
from tesselar.operators.hierarchy import radix_nodes
from tesselar.operators.order import fine_codes, morton_code
from tesselar.operators.traverse import BITS
from tesselar.plans.scratch import exclusive_sum, folder, save, with_position
from tesselar.schema import AXES, BOX, canonicalize, require_two

#: Children of a page, pages of the highest level, and runs an index may have before an append compacts it.
FAN, TOP, RUNS = 1 << BITS, 64, 8


class Run:
    """One sorted run of leaves, and the levels of its pages."""

    def __init__(self, spark: SparkSession, path: str, ranges: list[tuple[int, int, list[float]]], kind: T.DataType):
        self.spark, self.path, self.ranges, self.kind = spark, path, ranges, kind
        self.n = sum(n for _, n, _ in ranges)
        self.height = max(1, math.ceil(math.log(max(self.n, 1) / TOP, FAN)))
        while -(-self.n // FAN**self.height) > TOP:  # logarithms are rounded
            self.height += 1

    @classmethod
    def write(cls, boxes: DataFrame, path: str) -> Run:
        """Sorts canonical boxes in ranges, and writes them and their pages."""
        spark = boxes.sparkSession
        order = ("coarse", "fine", "idx")
        rows = fine_codes(boxes).repartitionByRange(*order).sortWithinPartitions(*order)
        row = F.monotonically_increasing_id()
        rows = rows.select("idx", row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), *BOX, F.shiftright(row, 33).cast("int").alias("at"))
        rows.write.partitionBy("at").parquet(f"{path}/leaves")
        run = cls._read(spark, path, boxes.schema["idx"].dataType)
        pages = run.leaves().groupBy(F.shiftright("pos", BITS).alias("page")).agg(F.count(F.lit(1)).alias("n"), *_bounds(), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
        pages.write.parquet(f"{path}/pages-1")
        for level in range(2, run.height + 1):
            up = run.pages(level - 1).groupBy(F.shiftright("page", BITS).alias("page")).agg(F.sum("n").alias("n"), *_bounds(), F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"))
            up.write.parquet(f"{path}/pages-{level}")
        return run

    @classmethod
    def _read(cls, spark: SparkSession, path: str, kind: T.DataType) -> Run:
        """The ranges of a written run: as many rows as there were partitions."""
        found = spark.read.schema(_leaf_schema(kind)).parquet(f"{path}/leaves").groupBy("at").agg(F.count(F.lit(1)).alias("n"), *_bounds()).collect()
        return cls(spark, path, sorted((r["at"], r["n"], [r[c] for c in BOX]) for r in found), kind)

    def leaves(self, ranges: list[int] | None = None) -> DataFrame:
        """(idx, box, pos) of all leaves, or of those in some ranges: only their files are read."""
        rows = self.spark.read.schema(_leaf_schema(self.kind)).parquet(f"{self.path}/leaves")
        if ranges is not None:
            rows = rows.where(F.col("at").isin(ranges))
        begin, starts = 0, []
        for at, n, _ in self.ranges:
            starts.append((at, begin))
            begin += n
        starts = F.broadcast(self.spark.createDataFrame(starts, "at int, begin long"))  # a row a range
        return rows.join(starts, "at").select("idx", *BOX, (F.col("begin") + F.col("row")).alias("pos"))

    def pages(self, level: int) -> DataFrame:
        """(page, n, box, first_idx, last_idx) of a level, 1 being that above the leaves."""
        schema = T.StructType([T.StructField("page", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in BOX], T.StructField("first_idx", self.kind), T.StructField("last_idx", self.kind)])
        return self.spark.read.schema(schema).parquet(f"{self.path}/pages-{level}")

    def meeting(self, centre: tuple[float, float, float], radius: float) -> list[int]:
        """Ranges whose box the ball meets."""
        reach = abs(radius) * (1 + 1e-9)
        return [at for at, _, box in self.ranges if all(box[i] <= c + reach and box[3 + i] >= c - reach for i, c in enumerate(centre))]


def _bounds() -> list:
    return [F.min(f"min_{a}").alias(f"min_{a}") for a in AXES] + [F.max(f"max_{a}").alias(f"max_{a}") for a in AXES]


def _leaf_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("idx", kind), T.StructField("row", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in BOX], T.StructField("at", T.IntegerType())])


class SpatialIndex:
    """The written index of a table of primitives, in one or more runs."""

    def __init__(self, spark: SparkSession, path: str, runs: list[Run] | None, kind: str, version: int = 0, boxes: DataFrame | None = None):
        self.spark, self.path, self._runs, self.kind, self.version, self._boxes = spark, path, runs, kind, version, boxes
        self._sorted, self._inner, self._packed = None, None, {}

    @classmethod
    def build(cls, df: DataFrame, kind: str = "points", path: str | None = None) -> SpatialIndex:
        """The index of a table, written under ``path`` if it is to be kept; fewer than two primitives raise ValueError."""
        require_two(canonicalize(df, kind).limit(2).count())
        return cls.of(df, kind, path)

    @classmethod
    def of(cls, df: DataFrame, kind: str = "points", path: str | None = None) -> SpatialIndex:
        """As ``build``, of any number of primitives."""
        index = cls(df.sparkSession, (path or folder(df.sparkSession, "index")).rstrip("/"), None, kind, boxes=canonicalize(df, kind))
        if path is not None:
            index.runs
            index._publish()
        return index

    @property
    def runs(self) -> list[Run]:
        if self._runs is None:
            self._runs = [Run.write(self._boxes, f"{self.path}/run-{0:06d}")]
        return self._runs

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SpatialIndex:
        """A kept index, with the runs it had when its list was last written."""
        home = path.rstrip("/")
        files, at = _files(spark, home)
        lists = sorted(f.getPath().getName() for f in files.listStatus(at) if re.fullmatch(r"list-\d+", f.getPath().getName()) and files.exists(_files(spark, f"{f.getPath()}/_SUCCESS")[1]))
        if not lists:
            raise ValueError(f"no index at {path}")
        rows = spark.read.parquet(f"{home}/{lists[-1]}").orderBy("run").collect()  # a row a run
        return cls(spark, home, [Run._read(spark, f"{home}/{r['run']}", T._parse_datatype_string(r["idx"])) for r in rows], rows[0]["kind"], int(lists[-1][5:]) + 1)

    def _publish(self) -> None:
        """Writes the list of runs: readers see a run once it is in a whole list, and a failed append leaves the list before."""
        rows = [(r.path.rpartition("/")[2], self.kind, r.kind.simpleString()) for r in self.runs]
        self.spark.createDataFrame(rows, "run string, kind string, idx string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list-{self.version:06d}")
        self.version += 1

    def append(self, df: DataFrame) -> SpatialIndex:
        """Adds a batch as a sorted run of its own; what is there is not read, unless there are more than RUNS runs then."""
        self.runs
        path = f"{self.path}/run-{self._next():06d}"
        self._runs = [*self.runs, Run.write(canonicalize(df, self.kind), path)]
        self._boxes = self._sorted = self._inner = None
        self._packed = {}
        if len(self.runs) > RUNS:
            return self.compact()
        self._publish()
        return self

    def compact(self) -> SpatialIndex:
        """Sorts all runs into one. The runs before stay for those who still read them, until the folder is removed."""
        if len(self.runs) > 1:
            self._runs = [Run.write(self._all(), f"{self.path}/run-{self._next():06d}")]
            self._publish()
        return self

    def _next(self) -> int:
        """A number no folder has; a run that a failed append left behind keeps its own."""
        files, at = _files(self.spark, self.path)
        return 1 + max(int(f.getPath().getName()[4:]) for f in files.listStatus(at) if f.getPath().getName().startswith("run-"))

    def _all(self) -> DataFrame:
        """(idx, box) of all primitives, from the runs if there are any."""
        if self._runs is None:
            return self._boxes
        return reduce(DataFrame.unionByName, [r.leaves().select("idx", *BOX) for r in self._runs])

    @property
    def n(self) -> int:
        if self._runs is not None:
            return sum(r.n for r in self._runs)
        return self._leaves()[1]

    def length(self) -> int:
        return self.n

    # ---- queries ---------------------------------------------------------------------------------------------------------

    def radius_search(self, centre: tuple[float, float, float], radius: float) -> DataFrame:
        """(idx, dist2) within the radius of one centre. Only the files of ranges that the ball meets are read."""
        return traverse.around(self, centre, radius)

    def radius_join(self, queries: DataFrame, radius: float | str) -> DataFrame:
        """(q, idx, dist2) for each query point; ``radius`` is a number, or the column of ``queries`` that has each one's own."""
        return packed.radius_join(self._blocks(False), traverse.with_radius(queries, radius))

    def knn(self, centre: tuple[float, float, float], k: int) -> DataFrame:
        """(rank, idx, dist2) of the k nearest to one centre."""
        one = self.spark.createDataFrame([(0, *map(float, centre))], "idx int, x double, y double, z double")
        return traverse.knn_join(self, one, k).select("rank", "idx", "dist2")

    def knn_join(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, rank, idx, dist2): the k nearest primitives of each query point, ties by idx."""
        traverse.require_k(k)
        # equal ids are queries of their own only if they lie apart
        return packed.knn_join(self._blocks(True), canonicalize(queries).distinct(), k)

    def _blocks(self, tiered: bool) -> DataFrame:
        """Packed primitives for joins with tables of queries, written once an index."""
        if tiered not in self._packed:
            self._packed[tiered] = packed.blocks_of(self._all(), tiered)
        return self._packed[tiered]

    # ---- the binary hierarchy --------------------------------------------------------------------------------------------

    def _leaves(self) -> tuple[DataFrame, int]:
        """(idx, code, box, pos, key) in the order of (code, idx), written once, and their number."""
        if self._sorted is None:
            rows = save(with_position(morton_code(self._all()), "code", "idx").withColumn("key", F.shiftleft("code", 32).bitwiseOR(F.col("pos"))), "leaves")
            n = rows.count()
            if n >= 1 << 32:
                raise ValueError("keys hold positions up to 2^32; build an index for each part of the scene")
            self._sorted = rows, n
        return self._sorted

    @property
    def leaves(self) -> DataFrame:
        return self._leaves()[0]

    def leaf_nodes(self) -> DataFrame:
        """(node_id, pos, prim_idx, code, box): leaf ids follow those of internal nodes."""
        return self.leaves.select((F.lit(self.n - 1) + F.col("pos")).cast("long").alias("node_id"), "pos", F.col("idx").alias("prim_idx"), "code", *BOX)

    def internal_nodes(self) -> DataFrame:
        """(node_id, left_id, right_id, first_pos, last_pos, split, level, box), made once an index."""
        if self._inner is None:
            leaves, n = self._leaves()
            self._inner = radix_nodes(leaves, n)
        return self._inner

    def nodes(self, relative: bool = False) -> DataFrame:
        """All nodes; a leaf has no children and a prim_idx. With ``relative`` child ids are offsets from the node's own."""
        inner = self.internal_nodes()
        child = [(F.col(c) - F.col("node_id")).alias(c) if relative else F.col(c) for c in ("left_id", "right_id")]
        inner = inner.select("node_id", *child, F.lit(None).cast(self.leaves.schema["idx"].dataType).alias("prim_idx"), "first_pos", "last_pos", F.lit(False).alias("is_leaf"), *BOX)
        none = F.lit(None).cast("long")
        leaf = self.leaf_nodes().select("node_id", none.alias("left_id"), none.alias("right_id"), "prim_idx", F.col("pos").alias("first_pos"), F.col("pos").alias("last_pos"), F.lit(True).alias("is_leaf"), *BOX)
        return inner.unionByName(leaf)

    def parents(self) -> DataFrame:
        """(child_id, parent_id); the root, node 0, is its own parent."""
        inner = self.internal_nodes().select("node_id", F.explode(F.array("left_id", "right_id")).alias("child_id"))
        root = self.spark.range(1).select(F.lit(0).cast("long").alias("child_id"), F.lit(0).cast("long").alias("parent_id"))
        return inner.select("child_id", F.col("node_id").alias("parent_id")).unionByName(root)

    def children(self) -> DataFrame:
        """(node_id, n_children, covers): whether a node's box is the union of its children's."""
        nodes = save(self.nodes(), "nodes")
        kids = nodes.select(F.col("node_id").alias("child_id"), *[F.col(c).alias(f"k_{c}") for c in BOX])
        links = nodes.where(~F.col("is_leaf")).select("node_id", F.explode(F.array("left_id", "right_id")).alias("child_id"))
        union = links.join(kids, "child_id").groupBy("node_id").agg(F.count(F.lit(1)).alias("n_children"), *[F.min(f"k_min_{a}").alias(f"k_min_{a}") for a in AXES], *[F.max(f"k_max_{a}").alias(f"k_max_{a}") for a in AXES])
        same = None
        for c in BOX:
            same = F.col(c) == F.col(f"k_{c}") if same is None else same & (F.col(c) == F.col(f"k_{c}"))
        return nodes.join(union, "node_id").select("node_id", "n_children", same.alias("covers"))

    def depths(self) -> DataFrame:
        """(node_id, depth) of all nodes. A leaf's depth is the number of ranges over it, a prefix sum of ranges that begin and end; a
        node's is that of its first leaf, less the nodes from it down to that leaf, all of which begin where it does."""
        inner = self.internal_nodes().select("node_id", "first_pos", "last_pos")
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        events = self.leaves.select("pos", zero.alias("begin"), zero.alias("end")).unionByName(inner.select(F.col("first_pos").alias("pos"), one.alias("begin"), zero.alias("end")))
        events = events.unionByName(inner.select(F.col("last_pos").alias("pos"), zero.alias("begin"), one.alias("end")))
        events = events.groupBy("pos").agg(F.sum("begin").alias("begin"), (F.sum("begin") - F.sum("end")).alias("open"))
        above = exclusive_sum(events, ["pos"], "open", "above").select("pos", "begin", "above")
        above = save(above, "above")
        leaf = above.select((F.lit(self.n - 1) + F.col("pos")).cast("long").alias("node_id"), (F.col("above") + F.col("begin")).alias("depth"))
        rank = F.row_number().over(Window.partitionBy("first_pos").orderBy(F.desc("last_pos"))) - 1  # as many as a key has bits at most
        inner = inner.join(above.withColumnRenamed("pos", "first_pos"), "first_pos").select("node_id", (F.col("above") + rank).cast("long").alias("depth"))
        return inner.unionByName(leaf)


def _files(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
