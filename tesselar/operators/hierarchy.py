"""The binary radix hierarchy over sorted keys, in time and rows linear in their number.

Neighbouring keys part at some bit; the node that splits there reaches, on either side, to the next gap that parts at a higher bit. So gaps
are closed from the lowest bit up: a gap joins the two intervals beside it into one node. A range of keys closes all nodes that end inside
it; of those that may go on beyond its borders, at most one a bit and side is open, and the intervals between these are all that is
handed on. Ranges are then taken together by the dozen in the same way, until one range is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.plans.scratch import save
from tesselar.schema import BOX

#: Least and most leaves of a range, and ranges taken together at a time.
RANGE = (1 << 12, 1 << 20)
TOGETHER = 64
#: An interval of leaves: its positions, the node that covers it, the keys at its ends and beside it (-1: none).
INTERVAL = ["first_pos", "last_pos", "node_id", "low_key", "high_key", "key_before", "key_after"]
_NODE = ["node_id", "left_id", "right_id", "first_pos", "last_pos", "split", "level"]
_LONGS = [*INTERVAL, "left_id", "right_id", "split", "level", "part"]


def _parting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exclusive or of keys, and the number of its highest bit; where there is no key, both are as large as can be."""
    none = (a < 0) | (b < 0)
    d = np.where(none, np.iinfo(np.int64).max, a ^ b)
    # keys have 62 bits; halves are exact as floating numbers
    high, low = d >> 31, d & ((1 << 31) - 1)
    bit = np.where(high > 0, np.frexp(high.astype(float))[1] + 30, np.frexp(low.astype(float))[1] - 1)
    return d, np.where(none, 99, bit).astype(np.int64)


def close(rows: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Closes the nodes inside a range of adjacent intervals, ordered by position. ``low`` and ``high`` are their boxes (m, 3).

    Returns the nodes with their boxes (k, 6), and the intervals that are left with theirs.
    """
    m = len(rows["first_pos"])
    low, high, node = low.copy(), high.copy(), rows["node_id"].copy()
    begin, end = np.arange(m), np.arange(m)  # of the interval that ends, or begins, at an element
    before, before_bit = _parting(rows["key_before"], rows["low_key"])
    after, bit = _parting(rows["high_key"], rows["key_after"])
    closed = np.zeros(m, bool)  # gaps after the elements; the last one is the border
    border = before_bit[0]
    found, boxes = {c: [] for c in _NODE}, []
    for b in np.unique(bit[:-1]):
        gap = np.flatnonzero(bit[:-1] == b)
        s, e = begin[gap], end[gap + 1]
        left = np.where(s > 0, bit[s - 1], border)
        ready = (left > b) & (bit[e] > b)
        gap, s, e = gap[ready], s[ready], e[ready]
        closed[gap] = True
        at_last = (rows["key_after"][e] >= 0) & ((rows["key_before"][s] < 0) | (after[e] < before[s]))
        first, last = rows["first_pos"][s], rows["last_pos"][e]
        number = np.where(at_last, last, first)
        low[s], high[s] = np.minimum(low[s], low[gap + 1]), np.maximum(high[s], high[gap + 1])
        for c, v in zip(_NODE, (number, node[s], node[gap + 1], first, last, rows["last_pos"][gap], np.full(len(gap), 62 - b))):
            found[c].append(v)
        boxes.append(np.hstack([low[s], high[s]]))
        end[s], begin[e], node[s] = e, s, number
    s = np.flatnonzero(~np.r_[False, closed[:-1]])
    e = end[s]
    rest = {"first_pos": rows["first_pos"][s], "last_pos": rows["last_pos"][e], "node_id": node[s], "low_key": rows["low_key"][s], "high_key": rows["high_key"][e], "key_before": rows["key_before"][s], "key_after": rows["key_after"][e]}
    whole = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in found.items()}
    return whole, np.vstack(boxes) if boxes else np.zeros((0, 6)), rest, np.hstack([low[s], high[s]])


def _schema() -> str:
    return ", ".join([*(f"{c} long" for c in _LONGS), *(f"{c} double" for c in BOX)])


def _batch(longs: dict[str, np.ndarray], boxes: np.ndarray, part: int) -> pa.RecordBatch:
    n = len(boxes)
    cols = [pa.array(np.full(n, part)) if c == "part" else pa.array(longs[c]) if c in longs else pa.nulls(n, pa.int64()) for c in _LONGS]
    return pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(boxes[:, i])) for i in range(6))], names=[*_LONGS, *BOX])


def _closing(is_leaf: bool):
    """A map over rows sorted by part and position, with all rows of a part together; it holds one part at a time."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        part = table.column("part")[0].as_py()
        col = lambda c: table.column(c).to_numpy()
        boxes = np.stack([col(c) for c in BOX], 1)
        if is_leaf:  # the rows at either end may be of the ranges beside it
            own = col("own")
            key, pos = col("key"), col("pos")
            rows = {"first_pos": pos, "last_pos": pos, "node_id": col("node_id"), "low_key": key, "high_key": key, "key_before": np.r_[-1, key[:-1]], "key_after": np.r_[key[1:], -1]}
            rows, boxes = {c: v[own] for c, v in rows.items()}, boxes[own]
        else:
            rows = {c: col(c) for c in INTERVAL}
        nodes, node_boxes, rest, rest_boxes = close(rows, boxes[:, :3], boxes[:, 3:])
        if len(node_boxes):
            yield _batch(nodes, node_boxes, -1)
        yield _batch(rest, rest_boxes, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            parts = batch.column(batch.schema.get_field_index("part")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and parts[a] != at:
                        yield from solve(pa.Table.from_batches(held))
                        held = []
                    at = parts[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def radix_nodes(leaves: DataFrame, n: int) -> DataFrame:
    """(node_id, left_id, right_id, first_pos, last_pos, split, level, box) of the n - 1 internal nodes over leaves (pos, key, box) with
    ascending keys. A node has the number of that end of its range beyond which keys part later, a leaf n - 1 and its position."""
    spark = leaves.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(max(-(-n // shuffles), RANGE[0]), RANGE[1])
    part = F.floor(F.col("pos") / size).cast("long")
    near = F.when(F.col("pos") % size == 0, F.array(part, part - 1)).when(F.col("pos") % size == size - 1, F.array(part, part + 1)).otherwise(F.array(part))
    rows = leaves.select("pos", "key", (F.lit(n - 1) + F.col("pos")).cast("long").alias("node_id"), *BOX, part.alias("mine"), F.explode(near).alias("part"))
    parts = -(-n // size)
    rows = rows.where((F.col("part") >= 0) & (F.col("part") < parts)).withColumn("own", F.col("mine") == F.col("part")).drop("mine")
    made, is_leaf, order = [], True, "pos"
    while True:
        dealt = rows.repartition(min(parts, shuffles), "part").sortWithinPartitions("part", order)
        out = save(dealt.mapInArrow(_closing(is_leaf), _schema()), "hierarchy")
        made.append(out.where("part = -1").select(*_NODE[:-1], F.col("level").cast("int").alias("level"), *BOX))
        if parts == 1:
            break
        rows = out.where("part >= 0").withColumn("part", F.floor(F.col("part") / TOGETHER).cast("long"))
        parts, is_leaf, order = -(-parts // TOGETHER), False, "first_pos"
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.unionByName(more)
    return nodes


