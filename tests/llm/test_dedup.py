import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.llm import components, exact_dedup, jaccard, line_dedup, queries
from tesselar.llm.common import Numbered, Scratch, WordHash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    mine = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert sorted(df.columns) == sorted(names) and mine == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    same(spark, sf, name)


def test_exact(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    for block in (7, 64, 4096):
        out = exact_dedup.exact_dedup(odd_docs, block=block).collect()
        groups = defaultdict(list)
        for d in rows:
            groups[(d.text or "").translate(FOLD)].append(d.doc_id)
        want = []
        for t, ids in groups.items():
            top = max((i for i in ids if i is not None), default=None)
            want += [(i, top, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        key = lambda x: tuple(map(str, x))
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=key) == sorted(want, key=key)
        kept = Counter(r.text_sha256 for r in out if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    left = exact_dedup.deduplicate(odd_docs)
    assert left.columns == odd_docs.columns and exact_dedup.deduplicate(no_docs).count() == 0
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted(((r.text or "").translate(FOLD), str(r.doc_id)) for r in left.collect()) == sorted((t, str(i)) for t, i in top.items())


def lines_by_hand(rows, least=10):
    keys = defaultdict(set)
    big = 1 << 62
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
            if len(k) >= least:
                keys[k].add(big if i is None else i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        drop = lambda x: len(keys.get(k := x.strip(" \t\n\x0b\x0c\r").translate(FOLD), ())) > 1 and min(keys[k]) != (big if i is None else i)
        kept = [x for x in parts if not drop(x)]
        out.append((str(i), len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines(spark, odd_docs, no_docs, monkeypatch):
    want = lines_by_hand([(d.doc_id, d.text) for d in odd_docs.collect()])
    for bits in (16, 1):  # filters much too small: more is shuffled, nothing wrong
        out = line_dedup.dedup_lines(odd_docs, bits=bits).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in out) == want
    assert line_dedup.dedup_lines(no_docs).count() == 0
    text = line_dedup.dedup_lines(odd_docs.withColumn("doc_id", odd_docs.doc_id.cast("string"))).collect()
    assert sum(r.n_dropped for r in text) > 0 and sorted((r.n_lines, str(r.doc_id)) for r in text) == sorted((n, i) for i, n, *_ in want)


def test_line_keys():
    texts = ["A b\x0b\n\n ÄÖ éÉ ü 12\x85\r\nshort\n" + "ñ" * 9 + "\n" + "ñ" * 10, "", " \x1cten chars..\x1c"]
    for t in texts:
        want = [k if len(k) >= 10 else "" for k in (x.strip(" \t\n\x0b\x0c\r").translate(FOLD) for x in t.split("\n"))]
        assert [k.decode() for k in line_dedup.keys_of(t.encode(), 10)] == want


@pytest.mark.parametrize("n", [1000, 300_000])
def test_suspects_stay_few(n):
    """All repeats are suspected, and a share of the others that doesn't depend on the number of hashes."""
    r = np.random.default_rng(n)
    h = r.integers(0, 1 << 63, n, dtype=np.uint64)
    h[: n // 10] = h[n // 2 : n // 2 + n // 10]
    again = np.zeros(n, bool)
    again[n // 5 : n // 5 + n // 100] = True
    seen, counts = np.unique(h, return_counts=True)
    true = np.isin(h, seen[counts > 1]) | again
    got = line_dedup.suspected(h, again)
    assert got[true].all() and got[~true].mean() < 0.02
    assert line_dedup.suspected(h, again, 1)[true].all() and len(line_dedup.suspected(h[:0], again[:0])) == 0


@pytest.mark.parametrize("name", ["deduplicate", "keep_one"])
def test_rows_hold_when_splits_change(spark, sf, name):
    """Scan splits that change between the call and the reading of its result change no row, and the right rows stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id as _row", "'x' as _ROW_", "'y' as component_id")
    conf = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}
    call = exact_dedup.deduplicate if name == "deduplicate" else jaccard.keep_one
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "13")
        left = call(docs)
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(left.collect())
    finally:
        for k in conf:
            spark.conf.unset(k)
    rows = docs.collect()
    if name == "deduplicate":
        last = {(r.text or "").translate(FOLD): r for r in sorted(rows, key=lambda r: r.doc_id)}
        want = list(last.values())
    else:
        parts = {}
        for r, x in zip(rows, join_by_hand([(r.doc_id, r.text) for r in rows], 5, 80)):
            if r.doc_id == x[2] or not x[3]:
                parts[r.doc_id] = r
        want = list(parts.values())
    assert got == sorted(want) and left.columns == docs.columns


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def join_by_hand(rows, size, percent):
    """(component, links) of each row by all pairs."""
    sets = [sets_of(t, size) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)], links[i]) for i in range(len(rows))]


def near_rows(seed, n=90):
    """Texts at all distances: copies with some words changed, chains of them, and shared passages."""
    r = random.Random(seed)
    bases = [[f"b{k}w{r.randrange(400)}" for _ in range(r.choice((3, 30, 80, 300)))] for k in range(8)]
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        if r.random() < 0.3:
            w += passage
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("size,percent,small", [(4, 85, False), (5, 80, True), (4, 60, True)])
def test_jaccard(spark, odd_docs, no_docs, monkeypatch, size, percent, small):
    if small:  # many blocks a group
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", (100, 400))
        monkeypatch.setattr(jaccard, "BLOCK_SIGNATURES", (300, 1000))
        monkeypatch.setattr(jaccard, "SPLIT", 2 if percent == 60 else 16)  # then groups of signatures have hubs too
        rows = near_rows(size)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        rows = [(d.doc_id, d.text) for d in odd_docs.collect()]
        docs = odd_docs
    plain = jaccard.jaccard_join(docs, size=size, percent=percent)
    out = jaccard.jaccard_join(docs, size=size, percent=percent, count_links=True).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out), key=key) == sorted(join_by_hand(rows, size, percent), key=key)
    assert "n_links" not in plain.columns
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.linked) for r in plain.collect()), key=key) == sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links > 0) for r in out), key=key)
    if not small:
        assert jaccard.jaccard_join(no_docs).count() == 0
        left = jaccard.keep_one(docs, size=size, percent=percent)
        assert left.columns == docs.columns
        groups = {(r.component_id if r.n_links else (r.doc_id, k)) for k, r in enumerate(out)}
        assert left.count() == len(groups)


def test_units_against_all_pairs():
    rows = near_rows(9, 120)
    sets = [s for s in (jaccard.shingle_set(t, 4, WordHash()) for _, t in rows) if len(s)]
    for percent in (50, 80, 100):
        want = {(min(i, j), max(i, j)) for i in range(len(sets)) for j in range(i) if 100 * (n := len(set(sets[i].tolist()) & set(sets[j].tolist()))) >= percent * (len(sets[i]) + len(sets[j]) - n)}
        unit = jaccard.Unit(sets, [0] * len(sets), percent)
        got = {(min(a, b), max(a, b)) for i, hit in unit.links() for j in hit.tolist() for a, b in [(int(unit.order[i]), int(unit.order[j]))]}
        assert got == want
        rough = jaccard.Rough([jaccard.signature(s) for s in sets], [len(s) for s in sets], [0] * len(sets), percent)
        may = {(min(a, b), max(a, b)) for i, hit in rough.links() for j in hit.tolist() for a, b in [(int(rough.order[i]), int(rough.order[j]))]}
        assert want <= may


def copies(n, apart=1, words=300):
    """n near copies of each of some texts, as shingle sets."""
    r, rows = random.Random(n), []
    for k in range(apart):
        base = [f"{k}w{i}" for i in range(words)]
        for _ in range(n):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(words)] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(w))
    return [jaccard.shingle_set(t, 4, WordHash()) for t in rows]


def test_joined_sets_are_not_compared():
    """With labels the components are those of all links; near copies cost in proportion to their number."""
    sets = [s for s in (jaccard.shingle_set(t, 4, WordHash()) for _, t in near_rows(9, 120)) if len(s)]

    def parts(unit, sides, start, labels):
        labels_ = jaccard.Labels(np.array(start)[unit.order])
        seen = sum(len(hit) for i, hit in unit.links(labels_ if labels else None) if labels_.join(i, hit) or True)
        groups = defaultdict(set)
        for k, g in zip(unit.order.tolist(), labels_.of.tolist()):
            groups[g].add(k)
        return sorted(map(sorted, groups.values())), seen

    for percent in (50, 80, 100):
        for sides in ([0] * len(sets), [k % 2 for k in range(len(sets))]):
            for start in (list(range(len(sets))), [k // 3 for k in range(len(sets))]):
                unit = jaccard.Unit(sets, sides, percent)
                want, pairs = parts(unit, sides, start, False)
                got, fewer = parts(unit, sides, start, True)
                assert got == want and fewer <= pairs
                rough = [jaccard.Rough([jaccard.signature(s) for s in sets], [len(s) for s in sets], sides, percent) for _ in range(2)]
                assert parts(rough[0], sides, start, False)[0] == parts(rough[1], sides, start, True)[0]
    cost = {}
    for n in (500, 1000):
        for kind in ("exact", "rough"):
            c = copies(n, 2)
            unit = jaccard.Unit(c, [0] * len(c), 85) if kind == "exact" else jaccard.Rough([jaccard.signature(s) for s in c], [len(s) for s in c], [0] * len(c), 85)
            groups, cost[kind, n] = parts(unit, None, list(range(len(c))), True)
            assert len(groups) == 2
    assert cost["exact", 1000] < 2.2 * cost["exact", 500] and cost["rough", 1000] < 2.2 * cost["rough", 500]


def test_hubs_join_near_copies(spark, monkeypatch):
    """Of a large group of near copies each class meets its hub once, and no units are left; texts near the threshold keep their links."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", (1000, 4000))
    pairs, call = [], jaccard.confirmed
    monkeypatch.setattr(jaccard, "confirmed", lambda p, *a: pairs.append(p.count()) or call(p, *a))
    base = [f"w{i}" for i in range(100)]
    for n in (200, 400):
        rows = [(k, " ".join([*base[:50], f"y{k}", *base[51:]])) for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        pairs.clear()
        out = jaccard.jaccard_join(docs, size=4, percent=85).collect()
        assert {x.component_id for x in out} == {0} and pairs == [n - 1]


def test_maybe_linked_is_what_rough_finds():
    sets = copies(12, 3, 60) + copies(2, 1, 2000)
    marks, sizes = [jaccard.signature(s) for s in sets], [len(s) for s in sets]
    rough = jaccard.Rough(marks, sizes, [0] * len(sets), 85)
    got = {frozenset((int(rough.order[i]), int(rough.order[j]))) for i, hit in rough.links() for j in hit}
    every = [(a, b) for a in range(len(sets)) for b in range(a) if min(sizes[a], sizes[b]) * 100 >= 85 * max(sizes[a], sizes[b])]
    assert got == {frozenset(p) for p in every if jaccard.maybe_linked(marks[p[0]], marks[p[1]], sizes[p[0]], sizes[p[1]], 85)}


def test_signatures_of_large_sets_fold():
    import numpy as np

    r = np.random.default_rng(1)
    big = np.unique(r.integers(0, 1 << 63, 13_000, dtype=np.uint64))
    cut = big[:11_500]
    rough = jaccard.Rough([jaccard.signature(x) for x in (big, cut)], [len(big), len(cut)], [0, 0], 85)
    assert [hit.tolist() for _, hit in rough.links()] == [[1], []]


@pytest.mark.parametrize("local", [0, 150, 200_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    mine, theirs = defaultdict(set), defaultdict(set)
    for x in got:
        mine[x.root].add(x.node)
    for x in list(parent):
        theirs[find(x)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_lists_are_read_in_bounds(monkeypatch):
    """Only positions after a set, up to what its likes can be linked with, are read; links are those of brute force."""
    r, calls, read = random.Random(5), [], jaccard.Unit._entries
    sets = []
    for k in range(12):
        base = r.sample(range(40 + 40 * k), 20 + 20 * k)
        for _ in range(6):
            sets.append(np.array(sorted({*r.sample(base, len(base) - r.randrange(4)), *r.sample(range(900), 2)}), np.uint64))
    monkeypatch.setattr(jaccard.Unit, "_entries", lambda self, t, low, high: calls.append((low, high)) or read(self, t, low, high))
    unit = jaccard.Unit(sets, [0] * len(sets), 80)
    got = {(min(a, b), max(a, b)) for i, hit in unit.links() for j in hit for a, b in [(int(unit.order[i]), int(unit.order[j]))]}
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    assert got and got == {(a, b) for a, b in pairs for x, y in [({*sets[a].tolist()}, {*sets[b].tolist()})] if 100 * len(x & y) >= 80 * len(x | y)}
    high = np.searchsorted(unit.sizes, unit.sizes * 100 // 80, "right")
    assert all(0 < low < end <= high[high[low - 1] - 1] for low, end in calls)
    assert sum(end - low for low, end in calls) < len(calls) * len(sets) / 2


def test_chains_join_what_may_be_linked():
    """Chains made a part at a time, and chained again, connect the same classes as whole lists."""
    r = random.Random(11)
    entries = [(r.randrange(6), k, r.choice((10, 11, 12, 14, 20, 21, 30))) for k in range(80)]

    def groups(pairs):
        parent = list(range(80))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return sorted(tuple(sorted(k for k in range(80) if find(k) == x)) for x in {find(k) for k in range(80)})

    whole, part = [], []
    for t in range(6):
        row = sorted((n, k) for x, k, n in entries if x == t)
        whole += [(a[1], b[1]) for a, b in zip(row, row[1:]) if 100 * a[0] >= 80 * b[0]]
    kept = []
    for at in range(0, 80, 17):
        pairs, found = jaccard.chains(*(np.array([e[i] for e in entries[at : at + 17]]) for i in range(3)), 80)
        part += pairs.tolist()
        kept += found.tolist()
    assert len(kept) < 80
    most = {}
    for t, k, low, high in sorted(kept, key=lambda x: (x[0], x[2])):
        if t in most and most[t][0] * 100 >= low * 80:
            part.append((most[t][1], k))
            high = max(high, most[t][0])
        most[t] = high, k
    assert groups(part) == groups(whole)


def test_frequent_shingles_are_few_rows(spark):
    """Classes that share a prefix shingle are sent as one chain a task."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40)) + f" x{i}") for i in range(400)], "doc_id long, text string").repartition(4)
    numbered = jaccard.Numbered(docs, Scratch(spark, "t"))
    rows = numbered.rows.selectExpr(f"{numbered.row} as row", "text")
    reps = numbered.facts(rows.select("row"), jaccard.F.shiftright("row", jaccard.BLOCK_ROWS))
    order = spark.sparkContext.broadcast(np.zeros(jaccard.COUNTERS, np.uint8))
    sent = jaccard._postings(rows, reps, 4, 80, order)
    lists = sent.where("low >= 0")
    assert lists.count() < 4 * 40 + 400 and sent.where("low < 0").count() <= 2 * 400
    got = components.components(jaccard._neighbours(sent, 80), Scratch(spark, "t")).collect()
    assert len(got) == 400 and len({x.root for x in got}) == 1


@pytest.mark.parametrize("percent", [50, 80, 85])
@pytest.mark.parametrize("most", [2, 5, 64])
def test_lists_join_what_may_be_linked(monkeypatch, percent, most):
    """Sets of all sizes and distances, lists shorter and longer than the bound, batches that cut them: linked sets are in one group."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "LIST", most)
    rng = np.random.default_rng(most)
    draw = lambda k: rng.integers(0, 2**63, k).astype(np.uint64)
    for _ in range(15):
        sets = []
        for base in [draw(rng.integers(1, 60)) for _ in range(12)]:
            for _ in range(rng.integers(1, 9)):
                sets.append(np.unique(np.r_[base[rng.random(len(base)) >= rng.choice([0, 0.02, 0.1])], draw(rng.integers(0, 3))]))
        sets = list({s.tobytes(): s for s in sets if len(s)}.values())
        order = np.zeros(jaccard.COUNTERS, np.uint8)
        rows = sorted((int(t), i, len(s), len(s), 0) for i, s in enumerate(sets) for t in jaccard.prefix(s, order, percent).view(np.int64))
        rows.sort(key=lambda r: (r[0], r[2]))
        step = int(rng.integers(1, 40))
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + step])], names=["token", "class", "low", "high", "other"]) for k in range(0, len(rows), step)]
        shared, parent = Counter(), list(range(len(sets)))
        for batch in jaccard.in_lists(percent)(iter(batches)):
            for a, b, k in zip(*(c.to_pylist() for c in batch.columns)):
                shared[a, b] += k

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for (a, b), k in shared.items():
            if k >= jaccard.SHARED:
                parent[find(a)] = find(b)
        assert all(find(a) == find(b) for a in range(len(sets)) for b in range(a) if jaccard.linked(sets[a], sets[b], percent))


def test_texts_that_share_shingles_by_chance_make_no_group(spark):
    """A ring of texts, each sharing one run of words with the next, is no group of candidates; two near copies are one."""
    vocab = [f"v{i}" for i in range(20_000)]
    r = random.Random(8)
    texts = [[r.choice(vocab) for _ in range(12)] for _ in range(60)]
    for i in range(60):
        texts[i][:4] = texts[i - 1][-4:]
    copy = [r.choice(vocab) for _ in range(80)]
    texts += [copy, [*copy[:-1], "other"]]
    scratch = Scratch(spark, "t")
    rows = scratch.save(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row long, text string").coalesce(1))
    numbered = Numbered(rows, scratch)
    order = spark.sparkContext.broadcast(np.zeros(jaccard.COUNTERS, np.uint8))
    sent = jaccard._postings(rows, numbered.facts(rows.select("row"), F.lit(0).cast("long")), 4, 80, order)
    assert [tuple(x) for x in jaccard._neighbours(sent, 80).collect()] == [(60, 61)]


def test_rows_meet_facts_where_they_lie(spark):
    """Equal to a join, for rows of several scan partitions and any number of facts a row, and the table's data isn't shuffled."""
    scratch = Scratch(spark, "t")
    numbered = Numbered(spark.range(0, 3000, 1, 7).select("id", F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("data")), scratch)
    held = numbered.rows.select(F.col(numbered.row).alias("class"), "data", "id")
    found = held.where("id % 3 = 0").select("class", F.explode(F.sequence(F.lit(0), F.pmod("id", F.lit(4)).cast("int"))).alias("k"), F.lit("x").alias("note"))
    met = numbered.meet(held, found, "class")
    assert not re.search("Join|Exchange", met._jdf.queryExecution().executedPlan().toString())
    want = held.join(found, "class").select(met.columns)
    assert met.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, want.collect())) and want.count() > 2000
    assert numbered.meet(held, found.where("k > 9"), "class").count() == 0


def test_sketch_grows_with_the_text(spark, monkeypatch):
    """Frequent shingles stand out of the sketch however many others there are, and its size makes no difference to the result."""
    assert [jaccard.counters_for(n) for n in (0, 200 << 20, 201 << 20, 1650 << 20, 10**12)] == [1 << 20, 1 << 20, 1 << 21, 1 << 24, 1 << 24]
    own = np.arange(10_000, dtype=np.uint64) << np.uint64(40)
    assert len(np.unique(jaccard._counter(own, 1 << 24))) == 10_000 > len(np.unique(jaccard._counter(own, 1 << 20)))
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{words(i // 2)} end{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda: sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_join(docs).collect())
    want = [(i, i // 2 * 2) for i in range(40)]
    assert got() == want
    monkeypatch.setattr(jaccard, "counters_for", lambda n: 1 << 22)
    assert got() == want
