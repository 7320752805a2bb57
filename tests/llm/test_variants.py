"""Operators 11 to 13 against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesselar.llm import divergence, hubs, minhash, spelling
from tesselar.llm.common import Scratch, mix

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- spelling variants -----------------------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, least=7, times=2, ratio=10, noise=31):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-z\\u00C0-\\u00FF]+", t or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= times}
    close = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if near(a, b):
                close[a].append(b), close[b].append(a)
    form = {w: min(close[w], key=lambda v: (-n[v], v)) for w in n if close[w]}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n[w], len(close[w]), n[form[w]] if w in form else 0) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_variants(spark, odd_docs, no_docs):
    r = random.Random(8)
    letters = "abcdeXYZéÿñ×"
    stems = ["".join(r.choice(letters) for _ in range(r.choice((7, 8, 9, 12)))) for _ in range(25)] + ["aaaaaaaa", "banananana", "ananananan", "ababababab"]

    def spoil(w):
        i, c = r.randrange(len(w) + 1), r.choice(letters)
        return r.choice((w, w, w, w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]))

    rows = [(i, " ".join(spoil(r.choice(stems[: 3 + i % 29])) + r.choice(("", "", ",", "1x", "ż")) for _ in range(60))) for i in range(150)]
    rows += [(8, "chainedx " * 2 + "chainedxy " * 30 + "chainedxyz " * 400), (7, "aaaaaaaa " * 200 + "aaaaaaa " * 12 + "aaaaaaaaa aaaaaaaaa"), (None, "banananana\nbanananan"), (None, None), (3, ""), (7, "x" * 5000 + " " + "x" * 5001 + " " + ("x" * 5000 + " ") * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "'clash' as word", "1 as n")
    want = variants_by_hand(rows)
    assert found(spelling.variants(df)) == want and sum(x[1] != "" for x in want) > 40 and any(x[1] != x[2] for x in want if x[1])
    assert found(spelling.variants(df, least_length=4, least_times=1, ratio=2, noise=5)) == variants_by_hand(rows, 4, 1, 2, 5)
    assert found(spelling.variants(odd_docs)) == variants_by_hand([(d.doc_id, d.text) for d in odd_docs.collect()])
    assert spelling.variants(no_docs).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, least_length=3)


def test_chains_of_forms_have_one_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(forms, Scratch(spark, "roots")).collect()}
    assert got == {**{f"w{i}": "w37" for i in range(37)}, "a": "w37"}


# ---- SuperMinHash ----------------------------------------------------------------------------------------------------------


def plain_signature(hashes, slots):
    """Shingle by shingle, every place of each one's order."""
    out = [2**64 - 1] * slots
    for x in hashes.tolist():
        order = list(range(slots))
        for j in range(slots):
            d = int(mix(np.array([(x + 0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)], np.uint64))[0])
            k = j + (((d >> 32) * (slots - j)) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], d & 0xFFFFFFFF | j << 32)
    return out


def test_signature_stops_early_but_is_whole(spark):
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 5, 40, 300, 3)]
    for slots in (12, 60, 300):
        got = minhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), slots)
        assert [g.tolist() for g in got] == [plain_signature(s, slots) for s in sets]
    # the share of equal slots estimates the similarity, with less spread than independent hashes have
    base, errors = r.integers(0, 2**63, 60, dtype=np.uint64), []
    for _ in range(200):
        a, b = r.permutation(base), r.integers(0, 2**63, 10, dtype=np.uint64)
        x, y = np.unique(a[:50]), np.unique(np.r_[a[:45], b[:5]])
        v = minhash.signatures(np.r_[x, y] ^ np.uint64(r.integers(2**62)), np.array([50, 50]))
        errors.append((v[0] == v[1]).mean() - 45 / 55)
    s = 45 / 55
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < s * (1 - s) / minhash.SLOTS


def components_by_hand(rows, size, percent):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(FOLD)) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        least[find(i)].append(name)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[find(i)]), rows[i][0] == least[find(i)]) for i in range(len(rows)))


def near_copies(seed, base=4, n=60, words=100, edits=7):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(900)]
    out = []
    for b in range(base):
        text = [r.choice(vocab) for _ in range(words)]
        for _ in range(n):
            t = list(text)
            for _ in range(r.randrange(edits)):
                t[r.randrange(words)] = r.choice(vocab)
            if r.random() < 0.1:
                text = t  # the text drifts, so that ends of a component have little in common
            out.append(" ".join(t))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("rounds,shingles,portion", [(3, 300_000, 500), (0, 300, 500), (1, 900, 3)])
def test_minhash_components(spark, monkeypatch, rounds, shingles, portion):
    """Equal to brute force with any number of rounds by hubs, and with small portions."""
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "SHINGLES", shingles)
    monkeypatch.setattr(hubs, "PORTION", portion)
    rows = near_copies(3) + [(1000 + i, "same words in every row of this group") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = minhash.near_duplicates(df, size=3, percent=85)
    want = components_by_hand(rows, 3, 85)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == want
    assert 20 < len({x[2] for x in want}) < 200


def test_minhash_odd_rows(spark, odd_docs, no_docs):
    for size, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(odd_docs, size=size, percent=percent)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == components_by_hand([(d.doc_id, d.text) for d in odd_docs.collect()], size, percent)
    assert minhash.near_duplicates(no_docs).count() == 0


# ---- source divergence -----------------------------------------------------------------------------------------------------


def audit_by_hand(rows, least=3, top=200):
    rows = [(l or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(FOLD))) for l, s, t in rows]
    docs, count = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, source, words in rows:
        docs[lang].update(set(words))
        count[lang][source].update(words)
    out = []
    for lang, sources in count.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in sources.items()}
        q = share(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in sources.items():
            parts = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            words = [("term", t, f(p[s][t], q[t])) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, cut in ((parts, None), (words, top)):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:cut]
                out += [(lang, s, *x, i + 1) for i, x in enumerate(ranked)]
    return sorted(out)


def test_audit(spark, odd_docs, no_docs, monkeypatch):
    r = random.Random(12)
    vocab = [f"{a}{b}" for a in ("tor", "ÉTÉ", "été", "Ab", "ж") for b in ("", "x", "yz", "ß")]
    rows = []
    for i in range(300):
        lang, source = r.choice(("en", "en", "en", "fr", None)), f"s{min(r.randrange(12), r.randrange(12))}"
        rows.append((lang, source, r.choice((" ", "-", "1", "\n")).join(r.choice(vocab[: 3 + hash(source) % 7 * 2 + 3]) for _ in range(r.randrange(40)))))
    rows += [("de", "only", "one word"), ("it", None, None), ("it", "x", "123"), ("en", "hot", "tor " * 3000)] + [("en", "s1", "tor tor tor")] * 40
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7).selectExpr("*", "'clash' as g", "0 as p", "1 as term")
    get = lambda df, **k: sorted(tuple(r) for r in divergence.audit(df, **k).collect())
    want = audit_by_hand(rows)
    assert get(df) == want and len(want) > 300
    monkeypatch.setattr(divergence, "_PAIRS", 30)  # a run's pairs in many portions
    monkeypatch.setattr(divergence, "_HELD_PAIRS", 20)
    monkeypatch.setattr(divergence, "_HELD", 40)  # short chains
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")  # runs that go on over batches
    try:
        assert get(df, least=2, top=5) == audit_by_hand(rows, 2, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert get(odd_docs) == audit_by_hand([(d.lang, d.source, d.text) for d in odd_docs.collect()])
    assert divergence.audit(no_docs).count() == 0


def test_entries_of_a_chain_and_bucket_are_one_row(spark, monkeypatch):
    """The shuffle of the entries moves a row a chain and bucket, however many terms there are; none is lost, whatever its bucket, and a
    chain that ends in the middle changes nothing."""
    rows = [(("en", "fr")[i % 2], f"s{i % 3}", " ".join(f"w{k:c}" for k in range(0x4E00 + i % 7, 0x4E00 + 3000, 1 + i % 4))) for i in range(24)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    packed = divergence.chains(df)
    assert 0 < packed.count() <= 2 * divergence.buckets(spark)
    docs, times = Counter(), Counter()
    for lang, source, text in rows:
        docs.update({(lang, t) for t in text.split()})
        times.update((lang, t, source) for t in text.split())
    want = {(*k, n, sum(times[k[0], k[1], f"s{s}"] for s in range(3)), docs[k[:2]]) for k, n in times.items() if docs[k[:2]] >= 8}
    assert 1000 < len({k[:2] for k in want}) < len(docs)
    for _ in range(2):
        got = divergence.kept_terms(divergence.chains(df), 8).collect()
        assert {(r.lang, bytes(r.term).decode(), r.source, r.times, r.total, r.docs) for r in got} == want and len(got) == len(want)
        assert Counter((r.lang, bytes(r.term)) for r in got if r.first) == dict.fromkeys({(k[0], k[1].encode()) for k in want}, 1)
        monkeypatch.setattr(divergence, "_HELD", 500)
        monkeypatch.setattr(divergence, "_OUT", 7)


def test_shares_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [(0, 0), (0, 7), (12, 1000), (big, 2 * big + 17), (8_999_999_999, 10**10), (9_000_000_000, 10**10)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "c long, n long")
    got = [x.p for x in df.select("c", "n", divergence._share(F.col("c"), F.col("n")).alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 1) // n if n else 1 for c, n in rows]
