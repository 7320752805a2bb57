"""N-gram Jaccard join by set-relation skipping.

1. Texts are written once with a number each. Documents with equal shingle sets (by a 128-bit digest) form a class, named by the smallest
   number; only classes are compared, and only the text with this number is read again.
2. A sketch of how often each shingle occurs, over all documents, with more counters for more text, orders shingles from rare to frequent. Similar sets share SHARED of
   their first shingles in this order (the prefix filter). Each shingle's index list is sorted by set size, and entries too far apart in
   size are skipped. Classes in short lists are candidates once they meet in SHARED lists: the more texts there are, the more of them
   share a shingle by chance, and if one sufficed, most would end up in one group. In long lists what remains side by side links classes
   into groups. A task chains the longer lists of its own classes first and sends a chain as one entry with the span of its sizes, so a
   frequent shingle is a few rows a task.
3. Groups are narrowed by signatures: bitmaps of the parity of each slot's shingles, which differ in at most as many bits as two sets
   do in shingles. Pairs that differ in more bits than a link allows are skipped; the rest form smaller groups.
4. The classes of a large group are first compared with one representative (its hub), in at most ROUNDS rounds; those that it is linked
   with are its members. A group whose classes are all joined is done. Of others only classes that are still apart are compared on: the
   largest component's members with the rest, never with one another.
5. A group is cut into blocks by size, large groups into at least SPLIT. Each pair of blocks whose sizes allow a link is a unit of work,
   holding the sets once. Within it, lists are sorted by set size, so the part of a list that is too small or large is skipped by position,
   and the overlaps of a set are derived from those of the set before it, where the two are similar: only the lists of the shingles in
   which they differ are read, and none if these are too few to make a link. Sets that are joined already aren't compared. So a unit of
   near copies costs in proportion to its sets, and no link between two components is left out.
6. Links that join something new become edges, and connected components give the classes their component. Only where the number of links
   of each document is asked for, steps 3 to 5 visit all links within a group, without a row a pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.plans.scratch import exclusive_sum

from .common import BLOCK_ROWS, Facts, Numbered, Scratch, WordHash, partitions, shingle_hashes, tidied, words_of
from .components import components
from .hubs import confirmed, linked

#: Least and most counters of the sketch, which has at most LOAD shingles a counter as far as these allow, so that frequent ones stand out; least and most shingles and bytes of signatures in a block of sets; blocks
#: that a group is cut into as far as these bounds allow.
COUNTERS = 1 << 20
MOST_COUNTERS = 1 << 24
LOAD = 200
BLOCK_SHINGLES = (20_000, 300_000)
BLOCK_SIGNATURES = (1 << 14, 1 << 19)
SPLIT = 16
#: Rounds with one hub a group.
ROUNDS = 2
#: Prefix shingles that classes share to be candidates; most entries of a list whose classes are paired; of one task's own, to be sent singly.
SHARED = 4
LIST = 64
OWN = 4
#: Prefix entries that a task chains at a time.
_FLUSH = 400_000
#: Bits of a signature, for sets up to so many shingles.
SIGNATURES = ((1 << 10, 1_500), (1 << 13, 12_000), (1 << 16, 1 << 62))
_SEGMENTS = 64


def shingle_set(text: str | None, size: int, hash_: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    return np.unique(shingle_hashes(hash_.array(words_of(text)), size))


def digest_of(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _counter(s: np.ndarray, counters: int) -> np.ndarray:
    return (s >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def counters_for(shingles: int) -> int:
    """Counters, a power of two, of a sketch of so many shingles."""
    out = COUNTERS
    while out < MOST_COUNTERS and shingles > LOAD * out:
        out *= 2
    return out


def needed(size: int, percent: int) -> int:
    """Least number of shingles shared with any similar set."""
    return -(-percent * size // 100)


def signature(s: np.ndarray) -> bytes:
    """Bit k is the parity of the number of shingles with slot k."""
    bits = next(b for b, most in SIGNATURES if len(s) <= most)
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _describe(rows: DataFrame, size: int, counters: int = COUNTERS) -> DataFrame:
    """Two kinds of rows: documents (row, n, digest, signature) and parts of the sketch (segment, counts)."""
    schema = "row long, n long, digest binary, signature binary, segment int, counts binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_, sketch, waiting, part_ = WordHash(), np.zeros(counters, np.uint32), [], counters // _SEGMENTS

        def count() -> None:
            np.add.at(sketch, np.concatenate(waiting), np.uint32(1))
            waiting.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digests, marks = [], [], []
                for t in part.column(1).to_pylist():
                    s = shingle_set(t, size, hash_)
                    n.append(len(s)), digests.append(digest_of(s) if len(s) else None), marks.append(signature(s) if len(s) else None)
                    waiting.append(_counter(s, counters))
                    if sum(map(len, waiting[-64:])) > 1_000_000 or len(waiting) >= 4000:
                        count()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        if waiting:
            count()
        if sketch.any():
            parts = [zlib.compress(sketch[k * part_ : (k + 1) * part_].tobytes(), 1) for k in range(_SEGMENTS)]
            nulls = [pa.nulls(_SEGMENTS, k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(_SEGMENTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return rows.mapInArrow(tidied(run), schema)


def _sketch(parts: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """Order classes of the counters: 0 for those near or below the mean, more for each doubling. Parts are summed as they
    come, first in as many tasks as there are partitions, then a segment a task; no task holds more than one sketch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total[k] + _counts(counts, part) if k in total else _counts(counts, part)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["segment", "counts"])

    n, part = partitions(parts.sparkSession), counters // _SEGMENTS
    summed = parts.repartition(max(1, n // 4)).mapInArrow(tidied(add), "segment int, counts binary").repartition(_SEGMENTS, "segment").mapInArrow(tidied(add), "segment int, counts binary")
    total = np.zeros(counters, np.uint64)
    for r in summed.toLocalIterator():
        total[r.segment * part : (r.segment + 1) * part] = _counts(r.counts, part)
    mean = max(1.0, total.mean())
    out = np.empty(counters, np.uint8)
    for at in range(0, counters, part):
        out[at : at + part] = np.clip(np.floor(np.log2(np.maximum(total[at : at + part], 1) / mean + 1e-9) * 2), 0, 60)
    return out


def _counts(data: bytes, part: int) -> np.ndarray:
    """The counters of a part: 32 bits each as a task made them, 64 bits once summed."""
    data = zlib.decompress(data)
    return np.frombuffer(data, np.uint32 if len(data) == 4 * part else np.uint64).astype(np.uint64)


def prefix(s: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the order (class of the counter, hash), enough for any similar set to share SHARED of them, or all that both have."""
    keep = len(s) - needed(len(s), percent) + SHARED
    # similar sets of other sizes share at least needed(len(s)), so this prefix serves for both sides
    rank = order[_counter(s, len(order))]
    return s[np.lexsort((s, rank))[:keep]]


def chains(token: np.ndarray, ids: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets side by side in a list whose sizes allow a link, and the chains that they make: (token, class, least size, most
    size). Sets that may be linked are in one chain: all sizes between theirs allow links too."""
    if not len(n):
        return np.zeros((0, 2), np.int64), np.zeros((0, 4), np.int64)
    by = np.lexsort((n, token))
    token, ids, n = token[by], ids[by], n[by].astype(np.int64)
    near = (token[1:] == token[:-1]) & (n[:-1] * 100 >= n[1:] * percent)
    first = np.flatnonzero(np.r_[True, ~near])
    last = np.r_[first[1:], len(n)] - 1
    pairs = np.stack([ids[:-1][near], ids[1:][near]], 1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs, np.stack([token[first], ids[first], n[first], n[last]], 1)


def _postings(rows: DataFrame, reps: Facts, size: int, percent: int, order) -> DataFrame:
    """(token, class, low, high, other): entries of a task's own classes, chains of those that are more than OWN in a list with ``other`` 1; and,
    with ``low`` -1, pairs of a class and another in such a chain."""
    names = ["token", "class", "low", "high", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_, tokens, ids, sizes, held = WordHash(), [], [], [], 0

        def out() -> pa.RecordBatch:
            lengths = [len(t) for t in tokens]
            token, name, n = np.concatenate(tokens).view(np.int64), np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
            _, at, often = np.unique(token, return_inverse=True, return_counts=True)
            long = often[at] > OWN
            pairs, found = chains(token[long], name[long], n[long], percent)
            token, name, n = token[~long], name[~long], n[~long]
            minus, one = np.full(len(pairs), -1, np.int64), np.ones(len(found), np.int64)
            cols = [np.r_[pairs[:, 0], found[:, 0], token], np.r_[pairs[:, 0], found[:, 1], name], np.r_[minus, found[:, 2], n], np.r_[minus, found[:, 3], n], np.r_[pairs[:, 1], one, np.zeros_like(n)]]
            for x in (tokens, ids, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        for batch, numbers, known in reps.beside(batches, 0):
            mine = np.isin(numbers, known.column(0).to_numpy())
            for row, t in zip(numbers[mine].tolist(), batch.column(1).filter(pa.array(mine)).to_pylist()):
                s = shingle_set(t, size, hash_)
                tokens.append(prefix(s, order.value, percent)), ids.append(row), sizes.append(len(s))
                held += len(tokens[-1])
                if held >= _FLUSH:
                    yield out()
                    held = 0
        if tokens:
            yield out()

    return rows.mapInArrow(tidied(run), ", ".join(f"{c} long" for c in names))


def in_lists(percent: int):
    """A map over entries sorted by token and least size to (a, b, shared): how many prefix shingles the classes a and b share, or SHARED where
    they must be in one group. Classes in a list of at most LIST entries, none of them a chain, are paired if their sizes allow a link;
    longer lists are chained as far as sizes side by side allow. At most LIST entries of a list are held."""

    def pairs_of(n: np.ndarray, ids: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
        out, step = [], 1
        while step < len(n) and (same := run[step:] == run[:-step]).any():
            near = np.flatnonzero(same & (n[:-step] * 100 >= n[step:] * percent))
            few = n[near + step] * percent <= 100 * (SHARED - 1)  # sets so small may share fewer
            out.append(np.stack([ids[near], ids[near + step], np.where(few, SHARED, 1)], 1))
            step += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = [np.zeros(0, np.int64)] * 5, None  # entries of the last list; of a long one only what its next entry may be chained with

        def settle(cols: list[np.ndarray], ended: bool) -> list[np.ndarray]:
            nonlocal held, open_
            token, ids, low, high, chain = cols
            out = []
            if len(token):
                starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                lengths = np.diff(np.r_[starts, len(token)])
                run = np.repeat(np.arange(len(starts)), lengths)
                long = (lengths > LIST) | (np.add.reduceat(chain, starts) > 0)
                if open_ is not None and open_[0][0] == token[0]:
                    long[0] = True
                wait = not ended and not long[-1]
                short = ~long[run]
                if wait:
                    short &= run != run[-1]
                out += pairs_of(low[short], ids[short], run[short])
                held = [c[run == run[-1]] if wait else c[:0] for c in cols]
                mine = long[run]
                token, ids, low, high = (c[mine] for c in cols[:4])
                if open_ is not None:
                    token, ids, low, high = (np.r_[x, y] for x, y in zip(open_, (token, ids, low, high)))
                open_ = None
                if len(token):
                    same = token[1:] == token[:-1]
                    far = np.cumsum(np.r_[0, ~same]) << 40  # the largest size so far in a list
                    most = np.maximum.accumulate(high + far) - far
                    near = np.flatnonzero(same & (most[:-1] * 100 >= low[1:] * percent) & (ids[:-1] != ids[1:]))
                    out.append(np.stack([ids[near], ids[near + 1], np.full(len(near), SHARED)], 1))
                    open_ = token[-1:], ids[-1:], low[-1:], most[-1:]
            return out

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate([np.zeros((0, 3), np.int64), *found])
            pairs, at = np.unique(np.sort(x[:, :2], axis=1), axis=0, return_inverse=True)
            shared = np.bincount(at.ravel(), weights=x[:, 2], minlength=len(pairs)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(shared)], names=["a", "b", "shared"])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(5)]
            is_pair = cols[2] < 0
            sure = np.stack([cols[1][is_pair], cols[4][is_pair], np.full(int(is_pair.sum()), SHARED)], 1)
            yield batch_of([sure, *settle([np.r_[h, c[~is_pair]] for h, c in zip(held, cols)], False)])
        yield batch_of(settle(held, True))

    return run


def _neighbours(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join all classes that may be linked: those that share SHARED prefix shingles in short lists, or are chained in a long one."""
    n = partitions(postings.sparkSession)
    lists = postings.repartition(n, "token").sortWithinPartitions("token", "low")
    found = lists.mapInArrow(tidied(in_lists(percent)), "a long, b long, shared long")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= SHARED).select("a", "b")


def _by_hubs(rows: DataFrame, held: DataFrame, percent: int, numbered: Numbered, above: int, test) -> tuple[DataFrame, DataFrame | None]:
    """The classes (class, n, root, w, comp, minor) that are still to be compared, and the edges found so far. ``rows`` are (class, n, root, w),
    ``held`` (class, n, data). Groups that weigh up to ``above`` are compared as they are; of others only those with several components
    are left. A class that isn't ``minor`` needs no comparison with another such class."""
    scratch = numbered.scratch
    rows = scratch.save(rows, "grouped")
    whole = rows.withColumn("comp", F.col("class")).withColumn("minor", F.lit(True))
    large = scratch.save(rows.groupBy("root").agg(F.sum("w").alias("all")).where(F.col("all") > above).select("root"), "large")
    if large.isEmpty():
        return whole, None
    now, edges = scratch.save(whole.join(large, "root"), "open"), None
    for salt in range(ROUNDS):
        hub = now.groupBy("root").agg(F.min(F.struct(F.xxhash64("class", F.lit(salt)), F.col("class"), F.col("n").alias("m"), F.col("comp").alias("comp2"))).alias("hub"))
        met = now.join(hub.select("root", F.col("hub.class").alias("hub"), "hub.m", "hub.comp2"), "root")
        met = met.where((F.col("comp") != F.col("comp2")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
        new = confirmed(met.select("hub", "class"), held.select("class", "data", "n"), test, numbered)
        edges = new if edges is None else edges.unionByName(new)
        found = components(edges, scratch).withColumnsRenamed({"node": "class", "root": "joined"})
        now = now.join(found, "class", "left").withColumn("comp", F.coalesce("joined", "class")).drop("joined")
        apart = now.groupBy("root").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("root")
        now = scratch.save(now.join(apart, "root"), "open")
        if now.isEmpty():
            break
    most = now.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("root").agg(F.max(F.struct("k", "comp"))["comp"].alias("largest"))
    now = now.join(most, "root").withColumn("minor", F.col("comp") != F.col("largest")).drop("largest")
    return whole.join(large, "root", "left_anti").unionByName(now), edges


def _units(rows: DataFrame, percent: int, scratch: Scratch, bounds: tuple[int, int]) -> DataFrame:
    """(class, root, comp, b1, b2, side): the units of work a class belongs to. A unit is a block of a group, or a pair of its blocks."""
    rows = exclusive_sum(rows, ["root", "minor", "n", "class"], "w", "before")  # over all groups, so that a large one is not in one task
    limit = F.least(F.greatest(F.ceil(F.sum("w") / SPLIT), F.lit(bounds[0])), F.lit(bounds[1])).alias("limit")
    begin = scratch.save(rows.groupBy("root").agg(F.min("before").alias("begin"), limit), "begin")
    blocks = rows.join(begin, "root").select("class", "n", "root", "comp", "minor", F.floor((F.col("before") - F.col("begin")) / F.col("limit")).alias("block"))
    blocks = scratch.save(blocks, "blocks")
    spans = blocks.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("minor").alias("some"))
    other = spans.withColumnsRenamed({"block": "right", "low": "low2", "high": "high2", "some": "some2"})
    sized = (F.col("high") * 100 >= F.col("low2") * percent) & (F.col("high2") * 100 >= F.col("low") * percent)
    pairs = spans.join(other, "root").where((F.col("right") > F.col("block")) & sized & (F.col("some") | F.col("some2")))
    pairs = scratch.save(pairs.select("root", "block", "right"), "pairs")
    alone = blocks.select("class", "root", "comp", F.col("block").alias("b1"), F.col("block").alias("b2"), F.lit(0).alias("side"))
    left = blocks.join(pairs, ["root", "block"]).select("class", "root", "comp", F.col("block").alias("b1"), F.col("right").alias("b2"), F.lit(0).alias("side"))
    right = blocks.withColumnRenamed("block", "right").join(pairs, ["root", "right"]).select("class", "root", "comp", F.col("block").alias("b1"), F.col("right").alias("b2"), F.lit(1).alias("side"))
    return alone.unionByName(left).unionByName(right)


def _sets(rows: DataFrame, wanted: Facts, size: int) -> DataFrame:
    """(class, shingles, size) of the wanted classes, each from the text that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_ = WordHash()
        for batch, numbers, known in wanted.beside(batches, 0):
            count = dict(zip(known.column("row").to_pylist(), known.column("size").to_pylist()))
            mine = np.isin(numbers, list(count))
            part, ids = batch.filter(pa.array(mine)), numbers[mine].tolist()
            for at in range(0, len(ids), 500):
                sets = [shingle_set(t, size, hash_).tobytes() for t in part.column(1).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 500], pa.int64()), pa.array(sets, pa.binary()), pa.array([count[i] for i in ids[at : at + 500]], pa.int64())], names=["class", "data", "size"])

    return rows.mapInArrow(tidied(run), "class long, data binary, size long")


def maybe_linked(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """Whether the signatures of two sets of n and m shingles allow a link."""
    few, more = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    differ = few ^ np.bitwise_xor.reduce(more.reshape(-1, len(few)), axis=0)
    return int(np.bitwise_count(differ).sum(dtype=np.int64)) * (100 + percent) <= (100 - percent) * (n + m)


class Labels:
    """Which sets of a unit are joined: those with one label."""

    def __init__(self, comp: np.ndarray):
        names, self.of = np.unique(comp, return_inverse=True)
        self.left = len(names)

    def apart(self, i: int, top: int) -> np.ndarray:
        """Which positions between i and top are not joined with i."""
        return self.of[i + 1 : top] != self.of[i]

    def join(self, i: int, hit: np.ndarray) -> list[int]:
        """Joins the sets of ``hit`` with i; one of them for each label that was another."""
        labels, first = np.unique(self.of[hit], return_index=True)
        new = labels != self.of[i]
        if new.any():
            to = np.arange(int(self.of.max()) + 1)
            to[labels] = self.of[i]
            self.of = to[self.of]
            self.left -= int(new.sum())
        return hit[first[new]].tolist()


class Rough:
    """The signatures of a unit, and all pairs that they allow to be links."""

    def __init__(self, marks: list[bytes], sizes: list[int], sides: list[int], percent: int):
        sizes, sides = np.array(sizes, np.int64), np.array(sides)
        self.order = np.lexsort((sides, sizes))
        self.sizes, self.sides, self.percent = sizes[self.order], sides[self.order], percent
        marks = [np.frombuffer(marks[i], np.uint8) for i in self.order]
        self.level = [len(m) * 8 for m in marks]
        self.folded = {}
        for bits in sorted(set(self.level)):  # longer signatures are folded to compare with shorter ones
            at = next(i for i, b in enumerate(self.level) if b >= bits)
            self.folded[bits] = at, np.stack([np.bitwise_xor.reduce(m.reshape(-1, bits // 8), axis=0) for m in marks[at:]]).view(np.uint64)

    def links(self, labels: Labels | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """For each set the larger or equal ones that it may be linked with; with ``labels``, which the caller keeps, only those not joined with it."""
        two = bool(self.sides.any()) and not self.sides.all()
        high = np.searchsorted(self.sizes, self.sizes * 100 // self.percent, "right")
        for i in range(len(self.sizes)):
            if labels is not None and labels.left == 1:
                return
            top = int(high[i])
            wanted = np.ones(top - i - 1, bool) if labels is None else labels.apart(i, top)
            if two:
                wanted &= self.sides[i + 1 : top] != self.sides[i]
            spots = np.flatnonzero(wanted) + i + 1
            at, marks = self.folded[self.level[i]]
            bits = np.bitwise_count(marks[spots - at] ^ marks[i - at]).sum(1, dtype=np.int64)
            yield i, spots[bits * (100 + self.percent) <= (100 - self.percent) * (self.sizes[i] + self.sizes[spots])]


class Unit:
    """The sets of a unit, and all links between them (between its two sides, if it has two)."""

    def __init__(self, sets: list[np.ndarray], sides: list[int], percent: int):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        order = np.lexsort((np.array(sides), self.sizes))
        self.order, self.percent = order, percent
        self.sets = [sets[i] for i in order]
        self.sizes, self.sides = self.sizes[order], np.array(sides)[order]
        flat = np.concatenate(self.sets)
        _, token = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        self.tokens = np.split(token, np.cumsum(self.sizes)[:-1])
        by = np.argsort(token, kind="stable")  # owners rise within a list, so lists are sorted by size
        self.lists = owner[by]
        self.places = token[by] * len(self.sets) + self.lists  # of all entries, by list and position

    def _entries(self, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """The entries with positions in [low, high) of some lists; what lies outside is skipped by position."""
        n = len(self.sets)
        a, b = np.searchsorted(self.places, tokens * n + low), np.searchsorted(self.places, tokens * n + high)
        ends = np.cumsum(b - a)
        return self.lists[np.arange(ends[-1]) + np.repeat(b - ends, b - a)] if len(ends) else np.zeros(0, np.int64)

    def _shared(self, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the tokens each set with a position in [low, high) has."""
        return np.bincount(self._entries(tokens, low, high) - low, minlength=high - low)

    def links(self, labels: Labels | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """For each set the larger or equal sets (by position in the order) that it is linked with; with ``labels``, which the caller
        keeps, only those not joined with it."""
        n, two = len(self.sets), bool(self.sides.any()) and not self.sides.all()
        high = np.searchsorted(self.sizes, self.sizes * 100 // self.percent, "right")
        shared, was, begin, reach = None, None, 0, 0  # ``shared`` counts for the positions in [begin, reach)
        for i in range(n):
            if labels is not None and labels.left == 1:
                return
            top = int(high[i])
            wanted = np.ones(top - i - 1, bool) if labels is None else labels.apart(i, top)
            if two:
                wanted &= self.sides[i + 1 : top] != self.sides[i]
            if not wanted.any():
                yield i, np.zeros(0, np.int64)
                continue
            mine = self.tokens[i]
            derived = False
            if was is not None and top <= reach:
                common = np.intersect1d(mine, was, assume_unique=True)
                if len(common) * 3 >= 2 * max(len(mine), len(was)):
                    gone, new = np.setdiff1d(was, common, assume_unique=True), np.setdiff1d(mine, common, assume_unique=True)
                    most = shared[i + 1 - begin : top - begin][wanted] + len(new)
                    if not (100 * most >= self.percent * (len(mine) + self.sizes[i + 1 : top][wanted] - most)).any():
                        continue
                    shared = shared[i + 1 - begin :] - self._shared(gone, i + 1, reach) + self._shared(new, i + 1, reach)
                    derived = True
            if not derived:
                reach = int(high[top - 1])  # what the sets that can be like this one need, to be derived from it
                shared = self._shared(mine, i + 1, reach)
            was, begin = mine, i + 1
            c = shared[: top - begin]
            union = len(mine) + self.sizes[i + 1 : top] - c
            hit = (100 * c >= self.percent * union) & (c > 0) & wanted
            yield i, np.flatnonzero(hit) + i + 1


def _solve(rows: DataFrame, percent: int, rough: bool = False, count: bool = False) -> DataFrame:
    """Links of each unit: (a, b) edges that join something new, and with ``count`` (a, null, links) the number of linked documents. With
    ``rough`` ``data`` holds signatures, and pairs are possible links."""
    schema = "a long, b long, links long"

    def flush(held: list[tuple]) -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        two = held[0][3] != held[0][4]
        ids, weight = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
        sides = [r[5] if two else 0 for r in held]
        if rough:
            unit = Rough([r[2] for r in held], weight.tolist(), sides, percent)
        else:
            unit = Unit([np.frombuffer(r[2], np.uint64) for r in held], sides, percent)
        ids, weight = ids[unit.order], weight[unit.order]
        links, labels = np.zeros(len(ids), np.int64), Labels(np.array([r[7] for r in held], np.int64)[unit.order])
        a, b = [], []
        for i, hit in unit.links(None if count else labels):
            if len(hit):
                if count:
                    links[i] += weight[hit].sum()
                    links[hit] += weight[i]
                new = labels.join(i, hit)
                a += [int(ids[i])] * len(new)
                b += ids[new].tolist()
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([*a, *ids[some].tolist()], pa.int64()), pa.array([*b, *[None] * len(some)], pa.int64()), pa.array([*[None] * len(a), *links[some].tolist()], pa.int64())],
            names=["a", "b", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit = [], None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("class", "size", "data", "b1", "b2", "side", "root", "comp")]
            for row in zip(*cols):
                key = row[6], row[3], row[4]
                if key != unit:
                    if (out := flush(held)) is not None:
                        yield out
                    held, unit = [], key
                held.append(row)
        if (out := flush(held)) is not None:
            yield out

    n = partitions(rows.sparkSession)
    # the units of a group, in order, are dealt to all partitions in turn
    turn = F.pmod(F.xxhash64("root") + (F.col("b2") * (F.col("b2") + 1) / 2).cast("long") + F.col("b1"), F.lit(n)).cast("int")
    return rows.repartitionById(n, turn).sortWithinPartitions("root", "b1", "b2", "class").mapInArrow(tidied(run), schema)


def _edges(grouped: DataFrame, held: DataFrame, percent: int, numbered: Numbered, bounds: tuple[int, int], rough: bool = False, count: bool = False) -> DataFrame:
    """What ``_solve`` finds within the groups (class, n, root, w), by hubs first unless links are counted."""
    test = (lambda a, b, n, m: maybe_linked(a, b, n, m, percent)) if rough else (lambda a, b, n, m: linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent))
    if count:
        rows, edges = grouped.withColumn("comp", F.col("class")).withColumn("minor", F.lit(True)), None
    else:
        rows, edges = _by_hubs(grouped, held, percent, numbered, bounds[1] * (SPLIT if rough else 1), test)
    data = held.select("class", "data", F.col("size") if "size" in held.columns else F.col("n").alias("size"))
    found = _solve(numbered.meet(data, _units(rows, percent, numbered.scratch, bounds), "class"), percent, rough, count)
    return found if edges is None else found.unionByName(edges.withColumn("links", F.lit(None).cast("long")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """One row a document: id, n_shingles, component_id, class, linked, and with ``count_links`` n_links.

    Sets of distinct ``size``-word shingles (the whole sequence, if it is shorter) are linked if 100 * shared >= percent * union.
    ``component_id`` is the smallest id reached by links, ``class`` a number that equal sets share, ``linked`` says whether there is a link,
    ``n_links`` is the number of other documents linked directly; to count it, time grows with the number of links between classes. Null and empty texts and texts without words have no shingles and no links; long texts are read whole; rows with
    equal ids are rows of their own; null ids are linked as any and never are the smallest. Other columns, whatever they are called, aren't
    read; an empty table gives an empty result.
    """
    numbered = Numbered(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")), Scratch(docs.sparkSession, "jaccard"))
    out = _joined(numbered, "doc", "text", size, percent, count_links).withColumnRenamed("doc", id_col).drop("row", "component")
    return out if count_links else out.drop("n_links")


def _joined(numbered: Numbered, id_col: str, text_col: str, size: int, percent: int, count: bool = False) -> DataFrame:
    """What ``jaccard_join`` returns, with the id called ``doc``, and the numbers of the row and of its component."""
    spark, scratch = numbered.rows.sparkSession, numbered.scratch
    rows = numbered.rows.select(F.col(numbered.row).alias("row"), F.col(text_col).cast("string").alias("text"))
    ids = numbered.rows.select(F.col(numbered.row).alias("row"), F.col(id_col).alias("doc"))
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    counters = counters_for(letters // 6)  # a word and what divides it from the next
    described = scratch.save(_describe(rows, size, counters), "sets")
    sets = scratch.save(described.where(F.col("segment").isNull()).select("row", "n", "digest").join(ids, "row"), "ids")
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("row").alias("class"), F.min("doc").alias("first"), F.count(F.lit(1)).alias("size"), F.min("n").alias("n"))
    classes = scratch.save(classes, "classes")
    order = spark.sparkContext.broadcast(_sketch(described.where(F.col("segment").isNotNull()).select("segment", "counts"), counters))
    sizes = classes.select("class", "n")

    reps = numbered.facts(classes.select(F.col("class").alias("row")), F.shiftright("row", BLOCK_ROWS))
    near = _neighbours(_postings(rows, reps, size, percent, order), percent)
    groups = scratch.save(components(near, scratch), "groups")
    weight = F.when(F.col("n") <= SIGNATURES[0][1], SIGNATURES[0][0] // 8).when(F.col("n") <= SIGNATURES[1][1], SIGNATURES[1][0] // 8).otherwise(SIGNATURES[2][0] // 8)
    marks = described.where(F.col("segment").isNull()).select(F.col("row").alias("class"), "n", F.col("signature").alias("data"))
    marks = numbered.meet(marks, groups.select(F.col("node").alias("class")), "class")
    marks = scratch.save(marks, "marks")
    edges = _edges(groups.join(sizes, groups.node == sizes["class"]).select("class", "n", "root", weight.cast("long").alias("w")), marks, percent, numbered, BLOCK_SIGNATURES, rough=True)
    groups = scratch.save(components(edges.select("a", "b"), scratch), "groups")

    wanted = groups.join(classes, groups.node == classes["class"]).select(F.col("class").alias("row"), "size")
    held = scratch.save(_sets(rows, numbered.facts(wanted, F.shiftright("row", BLOCK_ROWS)), size), "held")
    grouped = groups.join(sizes, groups.node == sizes["class"]).select("class", "n", "root", F.col("n").alias("w"))
    found = scratch.save(_edges(grouped, held.withColumn("n", F.octet_length("data") / 8), percent, numbered, BLOCK_SHINGLES, count=count), "links")
    scratch.drop(marks, held, described)
    joined = scratch.save(components(found.where(F.col("b").isNotNull()).select("a", "b"), scratch), "joined")
    links = found.where(F.col("links").isNotNull()).groupBy("a").agg(F.sum("links").alias("links"))

    known = classes.join(joined, classes["class"] == joined.node, "left").join(links, F.col("class") == F.col("a"), "left")
    known = scratch.save(known.select("digest", "class", "first", "size", "root", F.coalesce("links", F.lit(0)).alias("links")).where("root is not null or size > 1"), "known")
    least = known.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    known = scratch.save(known.join(least, "root", "left").select("digest", "class", F.coalesce("least", "first").alias("first"), F.coalesce("root", "class").alias("component"), F.lit(True).alias("linked"), (F.col("links") + F.col("size") - 1).alias("links")), "known")
    return sets.join(known, "digest", "left").select(
        "doc",
        F.col("n").alias("n_shingles"),
        F.when(F.col("linked"), F.col("first")).otherwise(F.col("doc")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class", "row").alias("class"),
        F.coalesce("linked", F.lit(False)).alias("linked"),
        "row",
        "component",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows without those that a similar row makes needless: of each component the row with the smallest id stays (null ids
    come last; of equal ids the row that was written first). Null and empty texts and texts without words are like nothing and stay; long texts
    are read whole; repeated rows are near copies like others. All columns as they were, whatever they are called. Rows are written once
    and numbered, and the result is a map over them; an empty table gives an empty table."""
    scratch = Scratch(docs.sparkSession, "keep")
    rows = Numbered(docs, scratch)
    found = scratch.save(_joined(rows, id_col, text_col, size, percent).where("linked").select("row", "doc", "component"))
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("id"), "row")).alias("best")
    best = scratch.save(found.groupBy("component").agg(best))
    return rows.without(found.join(best, "component").where(F.col("best.row") != F.col("row")).select("row"))
