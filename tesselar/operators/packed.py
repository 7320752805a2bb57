"""Joins of a whole table of queries with a table of primitives, by packed blocks of either.

Queries and primitives are sorted by fine Morton codes and packed, a block a row. All distances are taken between arrays; no (query, leaf) or
(query, page) row is shuffled. For a radius only the names of pairs of blocks are, and a task reads the blocks of its pairs from the shared folder, as
their number grows with the square of the tables. For nearest neighbours queries are sent to each block that may answer them, once.

For nearest neighbours the primitives are dealt to tiers by their position in the order of ids: the FIRST lowest, then GROWTH times as many, and so on.
Tiers are asked in turn, and a query goes on with the k-th (distance, id) found so far as its bound. So among any number of primitives at one
distance (overlapping boxes around a point, equal primitives) the lowest ids are met first, and tiers and blocks whose first id is beyond the bound are
never asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tesselar.operators.order import fine_codes
from tesselar.plans.scratch import opened, save, with_position
from tesselar.schema import AXES, BOX

#: Rows of a block, and of the parts of it that have a box of their own.
BLOCK, PART = 2048, 64
#: Primitives of the first tier, and how many times larger each further one ends.
FIRST, GROWTH = 2 * BLOCK, 8
#: Tasks that a tier of few blocks is dealt to.
SPREAD = 64
#: Blocks of queries, and open files, that a task holds.
HELD = 32
_NONE = np.iinfo(np.int64).max
#: Writes each row of a Parquet file as a row group, so that it can be read alone.
_SINGLY = {"parquet.block.row.count.limit": 1}
_QBOX = [f"q{c}" for c in BOX]


def _schema(**types) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t) if isinstance(t, str) else t) for n, t in types.items()])


def _batch(schema: T.StructType, cols: dict) -> pa.RecordBatch:
    out = to_arrow_schema(schema)
    arrays = [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in out]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, out)], schema=out)


def _listed(values: pa.Array) -> pa.Array:
    """An array as the one row of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _flat(values) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _float(value, width: int = 1) -> np.ndarray:
    out = np.frombuffer(value.as_buffer(), np.float64)
    return out.reshape(-1, width) if width > 1 else out


def _long(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int64)


def _pack(rows: DataFrame, extra: list[str]) -> DataFrame:
    """(tier, n, box, first, low, high, pos, ids, and for each of ``extra`` a binary of doubles and the most of them) of at most BLOCK rows each,
    sorted by fine codes. ``rows`` are read twice."""
    order = ("tier", "coarse", "fine", "pos")
    rows = fine_codes(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("tier", "pos", "idx", *BOX, *extra)
    schema = _schema(tier="int", n="int", **dict.fromkeys(BOX, "double"), first="long", low="binary", high="binary", pos="binary", ids=T.ArrayType(rows.schema["idx"].dataType), **dict.fromkeys(extra, "binary"), **{f"most_{c}": "double" for c in extra})

    def row(t: pa.Table) -> pa.RecordBatch:
        box = np.column_stack([t[c].to_numpy() for c in BOX])
        low, high, pos = box[:, :3], box[:, 3:], t["pos"].to_numpy()
        ends = dict(zip(BOX, [[v] for v in (*low.min(0), *high.max(0))]))
        values = {c: t[c].to_numpy().astype(np.float64) for c in extra}
        more = {c: [v.tobytes()] for c, v in values.items()} | {f"most_{c}": [v.max()] for c, v in values.items()}
        return _batch(schema, {"tier": [t["tier"][0].as_py()], "n": [len(t)], **ends, "first": [int(pos.min())], "low": [np.ascontiguousarray(low).tobytes()], "high": [np.ascontiguousarray(high).tobytes()], "pos": [pos.tobytes()], "ids": _listed(_flat(t["idx"])), **more})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, tier = [], 0, None
        for b in batches:
            tiers = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tiers)) + 1), len(tiers)]
            for a, z in zip(cuts, cuts[1:]):
                if z == a:
                    continue
                if tier != tiers[a] and n:
                    yield row(pa.Table.from_batches(held))
                    held, n = [], 0
                tier = tiers[a]
                held.append(b.slice(a, z - a))
                n += z - a
                while n >= BLOCK:
                    t = pa.Table.from_batches(held)
                    yield row(t.slice(0, BLOCK))
                    held, n = t.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield row(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def blocks_of(boxes: DataFrame, tiered: bool) -> DataFrame:
    """Packed primitives; with ``tiered`` dealt by their position in the order of ids, which breaks ties."""
    if not tiered:
        rows = save(boxes.select("idx", *BOX, F.lit(0).alias("tier"), F.lit(0).cast("long").alias("pos")), "boxes")
    else:
        rows = with_position(boxes, "idx")
        tier = sum((F.col("pos") >= F.lit(FIRST * GROWTH**i)).cast("int") for i in range(16))
        rows = rows.select("idx", *BOX, tier.alias("tier"), "pos")
    return save(_pack(rows, []).withColumn("block", F.monotonically_increasing_id()), "blocks", **_SINGLY)


def _queries(queries: DataFrame, extra: list[str]) -> DataFrame:
    """Packed query points (idx, box, extra): (qb, n, box as q.., at, ids, extra)."""
    rows = save(queries.select("idx", *BOX, *extra, F.lit(0).alias("tier"), F.lit(0).cast("long").alias("pos")), "asked")
    return _pack(rows, extra).select(F.monotonically_increasing_id().alias("qb"), "n", *[F.col(c).alias(q) for c, q in zip(BOX, _QBOX)], F.col("low").alias("at"), "ids", *extra, *[f"most_{c}" for c in extra])


def _distance2(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(m, n) squared distances of points from boxes, added up as ``nearest`` does."""
    out = None
    for i in range(3):
        d = at[:, i, None] - high[None, :, i]
        np.maximum(d, low[None, :, i] - at[:, i, None], out=d)
        np.maximum(d, 0.0, out=d)
        d *= d
        out = d if out is None else np.add(out, d, out=out)
    return out


class _Block:
    """The primitives of a packed row, with the boxes and first positions of its parts."""

    def __init__(self, low, high, pos):
        self.low, self.high, self.pos = _float(low, 3), _float(high, 3), _long(pos)
        self.cuts = np.arange(0, len(self.pos), PART)
        self.plow, self.phigh = np.minimum.reduceat(self.low, self.cuts), np.maximum.reduceat(self.high, self.cuts)
        self.first = np.minimum.reduceat(self.pos, self.cuts)

    def part(self, j: int) -> slice:
        return slice(int(self.cuts[j]), int(self.cuts[j]) + PART)


def _best(block: _Block, at: np.ndarray, bd: np.ndarray, bp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, position, place in the block) of up to k primitives a query that come before its bound, (m, k) each; -1 where there is none."""
    m = len(at)
    d, p, e = np.repeat(bd[:, None], k, 1), np.repeat(bp[:, None], k, 1), np.full((m, k), -1)
    reach = _distance2(at, block.plow, block.phigh)

    def meet(rows: np.ndarray, j: int) -> None:
        s = block.part(j)
        pos = block.pos[s]
        near = _distance2(at[rows], block.low[s], block.high[s])
        better = (near < d[rows, -1, None]) | (near == d[rows, -1, None]) & (pos[None, :] < p[rows, -1, None])
        some = better.any(1)
        rows, near, better = rows[some], near[some], better[some]
        if not len(rows):
            return
        alld = np.hstack([d[rows], np.where(better, near, np.inf)])
        allp = np.hstack([p[rows], np.where(better, pos[None, :], _NONE)])
        alle = np.hstack([e[rows], np.where(better, np.arange(s.start, s.start + len(pos))[None, :], -1)])
        first = np.lexsort((allp, alld), axis=-1)[:, :k]
        d[rows], p[rows], e[rows] = (np.take_along_axis(x, first, 1) for x in (alld, allp, alle))

    # a query meets the part first that begins soonest, and then those that still may matter
    own = np.where(reach == reach.min(1, keepdims=True), block.first, _NONE).argmin(1)
    for j in np.unique(own):
        meet(np.flatnonzero(own == j), j)
    for j in range(len(block.first)):
        rows = np.flatnonzero((own != j) & ((reach[:, j] < d[:, -1]) | (reach[:, j] == d[:, -1]) & (block.first[j] < p[:, -1])))
        if len(rows):
            meet(rows, j)
    return d, p, e


def _asked(state: DataFrame, blocks: DataFrame, prune, bounds: list[str], keep) -> DataFrame:
    """(qb, block, rows, at, bounds): the queries of each packed row that a block may answer. ``prune`` is a condition on a query block and a block,
    ``keep`` tells from distances (m, blocks), their first positions and the bounds which queries to send. Blocks are named by their boxes: a short
    row for BLOCK primitives. Without ``keep`` only pairs of places (qfile, qrow, file, row) come out, for ``_read``."""
    most = [c for c in state.columns if c.startswith("most_")]
    if keep is None:
        place = lambda q: [F.col("_metadata.file_name").alias(f"{q}file"), F.col("_metadata.row_index").alias(f"{q}row")]
        return state.select(*place("q"), *_QBOX, *most).crossJoin(F.broadcast(blocks.select(*place(""), *BOX))).where(prune).select("qfile", "qrow", "file", "row")
    pairs = state.select("qb", *_QBOX, *most).crossJoin(F.broadcast(blocks.select("block", "first", *BOX))).where(prune)
    pairs = pairs.groupBy("qb").agg(F.collect_list(F.struct("block", "first", *BOX)).alias("met"))
    joined = state.select("qb", "at", *bounds).join(pairs, "qb")
    schema = _schema(qb="long", block="long", rows="binary", at="binary", **dict.fromkeys(bounds, "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i]  # noqa: E731, B023
                at, own, met = _float(get("at"), 3), [_long(get(c)) if c == "bp" else _float(get(c)) for c in bounds], get("met").values
                names, first = met.field("block").to_numpy(), met.field("first").to_numpy()
                low, high = (np.column_stack([met.field(f"{m}_{a}").to_numpy() for a in AXES]) for m in ("min", "max"))
                for start in range(0, len(names), 256):
                    s = slice(start, start + 256)
                    use = keep(_distance2(at, low[s], high[s]), first[s], *own)
                    for j in np.flatnonzero(use.any(0)):
                        r = np.flatnonzero(use[:, j])
                        yield _batch(schema, {"qb": [get("qb").as_py()], "block": [int(names[start + j])], "rows": [r.astype(np.int64).tobytes()], "at": [at[r].tobytes()], **{c: [o[r].tobytes()] for c, o in zip(bounds, own)}})

    return joined.mapInArrow(run, schema)


def _read(saved: DataFrame, columns: list[str], held: int):
    """A function that reads one row of a table written ``_SINGLY`` by the name of its file and its place there; ``held`` rows are kept."""
    folder = next((f.rpartition("/")[0] for f in saved.inputFiles()), "")

    def reader():
        from pyarrow import parquet as pq

        @lru_cache(HELD)
        def file(name: str):
            files, path = opened(f"{folder}/{name}")
            return pq.ParquetFile(files.open_input_file(path))

        @lru_cache(held)
        def row(name: str, at: int) -> dict:
            t = file(name).read_row_group(at, columns=columns, use_threads=False)
            if len(t) != 1:
                raise RuntimeError(f"row group {at} of {folder}/{name} has {len(t)} rows")
            return {c: t[c][0] for c in columns}

        return row

    return reader


def _meet(asked: DataFrame, blocks: DataFrame, copies: int) -> DataFrame:
    """Asked rows with their block; the blocks of a small tier are copied, so that they are met in several tasks."""
    asked = asked.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "qb")  # few rows are much work
    packed = blocks.select("block", "low", "high", "pos", F.col("ids").alias("found"))
    if copies > 1:
        packed = packed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return asked.withColumn("copy", F.pmod(F.hash("qb"), F.lit(copies))).join(packed, ["block", "copy"])
    return asked.join(packed, "block")


def _apart() -> Column:
    """Squared distance between the box of a query block and that of a block."""
    d = [F.greatest(F.lit(0.0), F.col(f"min_{a}") - F.col(f"qmax_{a}"), F.col(f"qmin_{a}") - F.col(f"max_{a}")) for a in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def radius_join(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, idx, dist2) for queries (idx, box, b2) and packed primitives. A pair of blocks is a row of names in the shuffle, whatever they hold."""
    state = save(_queries(queries, ["b2"]), "queries", **_SINGLY)
    pairs = _asked(state, blocks, _apart() <= F.col("most_b2"), ["b2"], None)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(n, "qfile", "qrow", "file", "row").sortWithinPartitions("file", "row", "qfile", "qrow")  # few rows are much work
    kinds = state.schema["ids"].dataType.elementType, blocks.schema["ids"].dataType.elementType
    asked, answers = _read(state, ["at", "b2", "ids"], HELD), _read(blocks, ["low", "high", "pos", "ids"], 1)
    schema = _schema(q=kinds[0], idx=kinds[1], dist2="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, answer, last = asked(), answers(), None
        for b in batches:
            for qfile, qrow, file, row in zip(*(c.to_pylist() for c in b.columns)):
                if last is None or last[0] != (file, row):
                    found = answer(file, row)
                    last = (file, row), _Block(found["low"], found["high"], found["pos"]), found["ids"].values
                block, query = last[1], ask(qfile, qrow)
                at, b2 = _float(query["at"], 3), _float(query["b2"])
                reach = _distance2(at, block.plow, block.phigh)
                for j in range(len(block.first)):
                    r = np.flatnonzero(reach[:, j] <= b2)
                    if not len(r):
                        continue
                    near = _distance2(at[r], block.low[block.part(j)], block.high[block.part(j)])
                    x, y = np.nonzero(near <= b2[r, None])
                    if len(x):
                        yield _batch(schema, {"q": query["ids"].values.take(pa.array(r[x])), "idx": last[2].take(pa.array(y + j * PART)), "dist2": near[x, y]})

    return pairs.mapInArrow(run, schema)


def knn_join(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, rank, idx, dist2) for queries (idx, box) and packed primitives in tiers."""
    packed = _queries(queries, [])
    tiers = 1 + (blocks.agg(F.max("tier")).first()[0] or 0)
    qkind, kind = packed.schema["ids"].dataType.elementType, blocks.schema["ids"].dataType.elementType
    answers = _schema(qb="long", n="int", rows="binary", d="binary", p="binary", found=T.ArrayType(kind))
    state = _schema(qb="long", n="int", **dict.fromkeys(_QBOX, "double"), at="binary", ids=T.ArrayType(qkind), bd="binary", bp="binary", most_d="double", most_p="long", d="binary", p="binary", found=T.ArrayType(kind))
    both = [*state.names, "rows"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i]  # noqa: E731, B023
                rows = _long(get("rows"))
                d, p, e = _best(_Block(get("low"), get("high"), get("pos")), _float(get("at"), 3), _float(get("bd")), _long(get("bp")), k)
                x, y = np.nonzero(e >= 0)
                if len(x):
                    yield _batch(answers, {"qb": [get("qb").as_py()], "n": [len(x)], "rows": [rows[x].tobytes()], "d": [d[x, y].tobytes()], "p": [p[x, y].tobytes()], "found": _listed(get("found").values.take(pa.array(e[x, y])))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one query block follow each other, its state first; one state and one answer are held."""
        held = None

        def out() -> pa.RecordBatch:
            own, d, p, found = held
            last = np.lexsort((p[:, -1], d[:, -1]))[-1]
            cols = {c: own[c] for c in state.names if c not in ("bd", "bp", "most_d", "most_p", "d", "p", "found")}
            return _batch(state, {**cols, "bd": [d[:, -1].tobytes()], "bp": [p[:, -1].tobytes()], "most_d": [d[last, -1]], "most_p": [p[last, -1]], "d": [d.tobytes()], "p": [p.tobytes()], "found": _listed(found)})

        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i]  # noqa: E731, B023
                found = get("found").values
                if not get("rows").is_valid:
                    if held:
                        yield out()
                    held = {c: b.column(c).slice(i, 1) for c in state.names}, _float(get("d")).reshape(-1, k), _long(get("p")).reshape(-1, k), found
                    continue
                own, d, p, old = held
                q, counts = np.unique(_long(get("rows")), return_counts=True)
                column = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
                line = np.repeat(np.arange(len(q)), counts)
                alld, allp = (np.hstack([x[q], np.full((len(q), k), none)]) for x, none in ((d, np.inf), (p, _NONE)))
                alle = np.hstack([q[:, None] * k + np.arange(k), np.full((len(q), k), -1)])
                alld[line, k + column], allp[line, k + column], alle[line, k + column] = _float(get("d")), _long(get("p")), len(old) + np.arange(len(found))
                first = np.lexsort((allp, alld), axis=-1)[:, :k]
                d, p = d.copy(), p.copy()
                d[q], p[q] = np.take_along_axis(alld, first, 1), np.take_along_axis(allp, first, 1)
                take = np.arange(len(old)).reshape(-1, k)
                take[q] = np.take_along_axis(alle, first, 1)
                held = own, d, p, pa.concat_arrays([old, found]).take(pa.array(take.ravel()))
        if held:
            yield out()

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n")[i].as_py()
                far, none = np.full(n * k, np.inf), np.full(n * k, _NONE)
                yield _batch(state, {**{c: b.column(c).slice(i, 1) for c in ("qb", "n", *_QBOX, "at", "ids")}, "bd": [far[:n].tobytes()], "bp": [none[:n].tobytes()], "most_d": [np.inf], "most_p": [_NONE], "d": [far.tobytes()], "p": [none.tobytes()], "found": _listed(pa.nulls(n * k, to_arrow_schema(answers).field("found").type.value_type))})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i]  # noqa: E731, B023
                use = np.flatnonzero(_long(get("p")) != _NONE)
                yield _batch(result, {"q": get("ids").values.take(pa.array(use // k)), "rank": use % k + 1, "idx": get("found").values.take(pa.array(use)), "dist2": _float(get("d"))[use]})

    result = _schema(q=qkind, rank="long", idx=kind, dist2="double")
    at = save(packed.mapInArrow(start, state), "state")
    least = F.struct(_apart().alias("d"), F.col("first").alias("p"))
    keep = lambda near, first, bd, bp: (near < bd[:, None]) | (near == bd[:, None]) & (first[None, :] < bp[:, None])
    for tier in range(tiers):
        some = blocks.where(F.col("tier") == tier)
        asked = _asked(at, some, least <= F.struct(F.col("most_d").alias("d"), F.col("most_p").alias("p")), ["bd", "bp"], keep)
        # a tier has as many blocks at least as BLOCK goes into it
        copies = -(-SPREAD * BLOCK // (FIRST * GROWTH**tier))
        found = _meet(asked, some, copies).mapInArrow(answer, answers)
        found = at.withColumn("rows", F.lit(None).cast("binary")).unionByName(found, allowMissingColumns=True).select(*both)
        at = save(found.repartition("qb").sortWithinPartitions("qb", F.col("rows").isNotNull()).mapInArrow(merge, state), "state")
    return at.mapInArrow(rows, result)
