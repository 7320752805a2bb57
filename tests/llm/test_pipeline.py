import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline as cp
from tesselar.llm import langid

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs, items, contents):
    """The stages one after another on lists: rows are (doc_id, text)."""
    classify = langid.Classifier(contents)
    docs = [d for d in docs if not classify(d[1])[2]]
    last = {}
    for d in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        last[(d[1] or "").translate(FOLD)] = d
    docs = list(last.values())
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) for _, t in docs]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()) for w in words]
    holders, parent = defaultdict(list), list(range(len(docs)))
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, d in enumerate(docs):
        groups[find(i)].append(d)
    docs = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    tests = [t.lower().split() for _, t in items if t]
    grams = {tuple(w[k : k + 13]) for w in tests for k in range(len(w) - 12)}
    docs = [d for d in docs if not any(tuple(w[k : k + 13]) in grams for w in [(d[1] or "").lower().split()] for k in range(len(w) - 12))]
    return docs


def test_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = by_hand(rows, items, langid.sample(docs, "doc_id", "text", "lang"))
    out = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert set(out) == {i for i, _ in want}
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in want:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(out[i].ids, "<u4").tolist() == ids and out[i].n_tokens == len(ids)


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "bpe"]
    for k, (_, stage) in enumerate(cp.STAGES):
        some, none = stage(spark, odd_docs, sf), stage(spark, no_docs, sf)
        assert none.count() == 0 and some.count() > 0
        if k < 4:
            assert some.columns == none.columns == odd_docs.columns
