"""Near-duplicate detection by SuperMinHash signatures.

1. Texts are written once with a number each. Equal shingle sets (by a 128-bit digest) form a class, which is compared as one.
2. A set's signature has SLOTS values. Each shingle draws its own random order of the slots, and offers its j-th slot a value in [j, j + 1);
   a slot keeps the least offer. So the values of one shingle are spread over all slots, which makes the share of equal slots a better
   estimate of the similarity than independent hashes give. Once every slot has an offer below j + 1, no later one counts: long sets stop
   after their first.
3. BANDS bands of WIDTH slots: classes that agree in a band meet in a bucket. At a similarity of 0.85 a pair meets in none with a probability
   of 2e-9. 128 further bits, one a slot, rule out pairs that differ in more than MOST of them (at 0.85: 1e-11 to lose a pair).
4. Links are confirmed on full sets, in rounds without all pairs of a group: in each bucket every class is compared with one hub only, and
   what gets linked is joined (union-find). Buckets whose classes are all joined are done; the others get other hubs. At last only classes
   that are still apart in a bucket are compared with one another, so that no link between two components is left out.
5. A hub with many partners is dealt over tasks, which all get its set; no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_ROWS, Numbered, Scratch, WordHash, mix, partitions, tidied
from .components import components
from .hubs import confirmed, linked
from .jaccard import _sets, digest_of, shingle_set

WIDTH, BANDS = 6, 42
SLOTS = WIDTH * BANDS
#: Most of the 128 bits in which a linked pair may differ.
MOST = 34
#: Rounds with one hub a bucket; shingles of either side of a unit.
ROUNDS = 3
SHINGLES = 300_000
#: Shingles whose signatures are made at a time.
_ELEMENTS = 40_000
_LOW, _ONE = np.uint64(0xFFFFFFFF), np.uint64(32)


def signatures(hashes: np.ndarray, lengths: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values (sets, slots) of sets of distinct 64-bit hashes, one after another, none of them empty. A value's upper half is
    the step at which its shingle came to the slot, its lower half the offer's fraction."""
    n = len(lengths)
    owner = np.repeat(np.arange(n) * slots, lengths)
    out = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for step in range(slots):
        drawn = mix(hashes + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) & (2**64 - 1)))
        pick = step + ((drawn >> _ONE) * np.uint64(slots - step) >> _ONE).astype(np.int64)
        if step == 0:
            slot = pick
        else:  # the step-th place of each shingle's own order, drawn among the slots it has not had
            every = np.arange(len(owner))
            slot = order[every, pick]
            order[every, pick] = order[:, step]
        np.minimum.at(out, owner + slot, (drawn & _LOW) | np.uint64(step << 32))
        open_ = out.reshape(n, slots).max(1) >= np.uint64((step + 1) << 32)
        if not open_.any():
            break
        keep = open_[owner // slots]
        if step == 0:
            owner, hashes, first = owner[keep], hashes[keep], pick[keep]
            order = np.tile(np.arange(slots, dtype=np.uint16 if slots > 256 else np.uint8), (len(owner), 1))
            order[np.arange(len(owner)), first] = 0  # 0 went to the place of the first pick
        elif keep.sum() * 2 < len(keep):
            owner, hashes, order = owner[keep], hashes[keep], order[keep]
    return out.reshape(n, slots)


def bands(values: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A 64-bit key a band, different for equal values in different bands."""
    n, slots = values.shape
    cut = values.reshape(n, slots // width, width)
    key = np.broadcast_to(np.arange(slots // width, dtype=np.uint64), cut.shape[:2]).copy()
    for i in range(width):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return key


def marks(values: np.ndarray) -> np.ndarray:
    """128 bits a set, one of each of the first slots."""
    return np.packbits((mix(values[:, :128]) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)


def _described(rows: DataFrame, size: int) -> DataFrame:
    """(row, n, digest, low, high, bands) of each row; without shingles only n = 0."""
    names = ["row", "n", "digest", "low", "high", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_ = WordHash()

        def out(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            low, high, keys = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [None] * len(n)
            if len(some):
                values = signatures(np.concatenate([sets[i] for i in some]), n[some])
                bits = marks(values)
                low[some], high[some] = bits[:, 0], bits[:, 1]
                for i, k in zip(some.tolist(), bands(values)):
                    keys[i] = k.tobytes()
            digests = [digest_of(s) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(digests, pa.binary()), pa.array(low), pa.array(high), pa.array(keys, pa.binary())], names=names)

        for batch in batches:
            ids, sets, held = [], [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, size, hash_)
                ids.append(row), sets.append(s)
                held += len(s)
                if held >= _ELEMENTS:
                    yield out(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield out(ids, sets)

    return rows.mapInArrow(tidied(run), "row long, n long, digest binary, low long, high long, bands binary")


def _shared(members: DataFrame) -> DataFrame:
    """(key, class) of the buckets with several classes. Rows are sorted by key and streamed: of a bucket only its first class is held, until
    a second one shows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "class"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, gone = None, False  # the last row, and whether it has been handed on
        for batch in batches:
            if not batch.num_rows:
                continue
            key, name = (batch.column(i).to_numpy() for i in (0, 1))
            if last is not None:
                key, name = np.r_[last[0], key], np.r_[last[1], name]
            same = key[1:] == key[:-1]
            keep = np.r_[same, False] | np.r_[False, same]
            last, kept = (key[-1], name[-1]), bool(keep[-1])
            keep[0] &= not gone
            gone = kept
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(name[keep])], names=["key", "class"])

    rows = members.select("class", "bands").mapInArrow(tidied(spread), "key long, class long")
    return rows.repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key").mapInArrow(tidied(several), "key long, class long")


def _likely(percent: int) -> Column:
    """Whether classes (n, low, high) and (m, low2, high2) may be linked."""
    differ = F.bit_count(F.col("low").bitwiseXOR(F.col("low2"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high2")))
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (differ <= MOST)


def _hubs(entries: DataFrame, salt: int, percent: int) -> DataFrame:
    """(hub, class) pairs to be compared, one a class: the class whose hash is least is a bucket's hub, and of the hubs of its buckets a class
    meets the one it shares most of them with. ``comp``: what is joined already."""
    best = entries.groupBy("key").agg(F.min(F.struct(F.xxhash64("class", F.lit(salt)), F.col("class"), F.col("n").alias("m"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("comp").alias("comp2"))).alias("hub"))
    best = best.select("key", F.col("hub.class").alias("hub"), "hub.m", "hub.low2", "hub.high2", "hub.comp2")
    met = entries.join(best, "key").where((F.col("comp") != F.col("comp2")) & _likely(percent)).groupBy("hub", "class").agg(F.count(F.lit(1)).alias("k"))
    return met.groupBy("class").agg(F.max(F.struct("k", "hub"))["hub"].alias("hub")).select("hub", "class")


def _apart(entries: DataFrame, members: DataFrame, held: DataFrame, percent: int, numbered: Numbered) -> DataFrame:
    """(a, b): links between classes of a bucket that are not joined, enough of them to join what all of them join.

    The largest component of a bucket is compared with the others, and these with one another. The others (hubs) and all classes are
    dealt to portions, and a unit gets one portion of either kind. Units find by bits which pairs to look at, a pair only in the first band
    it shares; then the sets of these classes are sent to the unit once, whatever the number of pairs.
    """
    scratch = numbered.scratch
    sizes = entries.groupBy("key", "comp").agg(F.sum("n").alias("k"))
    most = sizes.groupBy("key").agg(F.max(F.struct("k", "comp"))["comp"].alias("largest"), F.sum("k").alias("all"), F.max("k").alias("k"))
    rows = entries.join(most, "key").withColumn("minor", F.col("comp") != F.col("largest"))
    rows = rows.join(members.select("class", "bands"), "class")
    portions = lambda c: F.ceil(c / SHINGLES).cast("long")
    p, q = portions(F.col("all") - F.col("k")), portions(F.col("all"))
    turn = lambda n: F.pmod(F.xxhash64("class"), n)
    cols = ["key", "class", "n", "low", "high", "comp", "minor", "bands"]
    hubs = rows.where("minor").select(*cols, turn(p).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), q - 1)).alias("j"), F.lit(True).alias("is_hub"))
    rest = rows.select(*cols, F.explode(F.sequence(F.lit(0).cast("long"), p - 1)).alias("i"), turn(q).alias("j"), F.lit(False).alias("is_hub"))

    def pairs(unit: int, key: int, hubs: list[tuple], rest: list[tuple]) -> pa.RecordBatch | None:
        """Rows (unit, class, comp) of the classes to compare, and (unit, class, comp, others) of the pairs."""
        x, y = (np.array([r[:6] for r in side], np.int64) for side in (hubs, rest))  # class, n, low, high, comp, minor
        kx, ky = (np.frombuffer(b"".join(r[6] for r in side), np.int64).reshape(len(side), -1) for side in (hubs, rest))
        found, comp = {}, {}
        for row, mine in zip(x, kx):
            differ = np.bitwise_count((y[:, 2:4] ^ row[2:4]).view(np.uint64)).sum(1)  # of signed numbers it would count the bits of the absolute value
            near = (differ <= MOST) & (y[:, 4] != row[4]) & (100 * np.minimum(y[:, 1], row[1]) >= percent * np.maximum(y[:, 1], row[1]))
            near &= (y[:, 5] == 0) | (y[:, 0] > row[0])  # pairs of hubs once
            at = np.flatnonzero(near)
            first = (ky[at] == mine).argmax(1)
            at = at[mine[first] == key]
            if len(at):
                found[int(row[0])] = y[at, 0].tolist()
                comp[int(row[0])] = int(row[4])
                comp.update(zip(y[at, 0].tolist(), y[at, 4].tolist()))
        if not found:
            return None
        names = [*comp, *found]
        others = pa.array([*[None] * len(comp), *found.values()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([unit] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array([comp[c] for c in names], pa.int64()), others], names=["unit", "class", "comp", "others"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, key, hubs, rest = None, None, [], []
        for batch in batches:
            for u, k, is_hub, *row in zip(*(batch.column(c).to_pylist() for c in ("unit", "key", "is_hub", "class", "n", "low", "high", "comp", "minor", "bands"))):
                if u != unit:
                    if hubs and rest and (out := pairs(unit, key, hubs, rest)) is not None:
                        yield out
                    unit, key, hubs, rest = u, k, [], []
                (hubs if is_hub else rest).append(tuple(row))
        if hubs and rest and (out := pairs(unit, key, hubs, rest)) is not None:
            yield out

    n = partitions(entries.sparkSession)
    both = hubs.unionByName(rest).withColumn("unit", F.xxhash64("key", "i", "j")).drop("i", "j")
    near = scratch.save(both.repartition(n, "unit").sortWithinPartitions("unit", "key").mapInArrow(tidied(look), "unit long, class long, comp long, others array<long>"), "near")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sets, comp, parent = None, {}, {}, {}

        def find(c: int) -> int:
            while parent.setdefault(c, c) != c:
                c = parent[c]
            return c

        for batch in batches:
            a, b = [], []
            for u, name, own, others, data in zip(*(batch.column(c).to_pylist() for c in ("unit", "class", "comp", "others", "data"))):
                if u != unit:
                    unit, sets, comp, parent = u, {}, {}, {}
                if others is None:  # a unit's sets come first
                    sets[name], comp[name] = np.frombuffer(data, np.uint64), own
                    continue
                for other in others:
                    x, y = find(own), find(comp[other])
                    if x != y and linked(sets[name], sets[other], percent):
                        parent[x] = y
                        a.append(name), b.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    wanted = numbered.meet(held.select("class", "data"), near.where("others is null").select("unit", "class", "comp"), "class")
    wanted = wanted.select("unit", "class", "comp", F.lit(None).cast("array<long>").alias("others"), "data")
    rows = near.where("others is not null").withColumn("data", F.lit(None).cast("binary")).unionByName(wanted)
    rows = rows.withColumn("is_pairs", F.col("others").isNotNull()).repartition(n, "unit").sortWithinPartitions("unit", "is_pairs").drop("is_pairs")
    return scratch.save(rows.mapInArrow(tidied(confirm), "a long, b long"), "confirmed")


def _links(members: DataFrame, numbered: Numbered, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of the classes that links join."""
    scratch = numbered.scratch
    shared = scratch.save(_shared(members), "shared")
    whole, members = members, scratch.save(numbered.meet(members, shared.select("class").distinct(), "class"), "members")
    scratch.drop(whole)
    entries = scratch.save(shared.join(members.select("class", "n", "low", "high"), "class"), "entries")
    wanted = members.select(F.col("class").alias("row")).withColumn("size", F.lit(1).cast("long"))
    held = scratch.save(_sets(rows, numbered.facts(wanted, F.shiftright("row", BLOCK_ROWS)), size), "held")
    sized = held.select("class", "data", F.lit(None).cast("long").alias("n"))
    test = lambda a, b, n, m: linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
    found, edges = None, None
    now = entries.withColumn("comp", F.col("class"))
    for step in range(ROUNDS + 1):
        new = confirmed(_hubs(now, step, percent), sized, test, numbered) if step < ROUNDS else _apart(now, members, held, percent, numbered)
        edges = new if edges is None else edges.unionByName(new)
        found = scratch.save(components(edges, scratch), "joined")
        if step < ROUNDS:
            now = entries.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root")
            apart = now.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
            now = scratch.save(now.join(apart, "key"), "open")
            if now.isEmpty():
                break
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept.

    Sets of distinct ``size``-word shingles (the whole sequence, if it is shorter) are linked if 100 * shared >= percent * union;
    ``component_id`` is the smallest id reached by links, ``kept`` says whether it is the document's own. Null and empty texts and texts
    without words have no shingles and no links; long texts are read whole; rows with equal ids are rows of their own, and all rows with
    the smallest id are kept; null ids are linked as any, never are the smallest, and are kept if no row with an id is linked with them.
    No other column is read, whatever it is called; an empty table gives an empty result. Bands find a pair at the threshold with the
    probability given above for 85 percent; at 80 percent they miss one in 3 million.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    numbered = Numbered(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")), scratch)
    rows = numbered.rows.select(F.col(numbered.row).alias("row"), "text")
    ids = numbered.rows.select(F.col(numbered.row).alias("row"), "doc")
    described = scratch.save(_described(rows, size), "signatures")
    sets = scratch.save(described.select("row", "n", "digest").join(ids, "row"), "ids")
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("row").alias("class"), F.min("doc").alias("first"), F.count(F.lit(1)).alias("size"))
    classes = scratch.save(classes, "classes")
    members = numbered.meet(described, classes.select(F.col("class").alias("row")), "row").withColumnRenamed("row", "class")
    members = scratch.save(members, "members")
    scratch.drop(described)
    joined = _links(members, numbered, rows, size, percent)

    known = classes.join(joined, classes["class"] == joined.node, "left").where("root is not null or size > 1")
    known = scratch.save(known.select("digest", "first", F.coalesce("root", "class").alias("component")), "known")
    least = known.groupBy("component").agg(F.min("first").alias("least"))
    known = scratch.save(known.join(least, "component").select("digest", "least"), "known")
    component = F.when(F.col("known"), F.col("least")).otherwise(F.col("doc"))
    out = sets.join(known.withColumn("known", F.lit(True)), "digest", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))
