import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tesselar.llm import bpe, queries

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", "   ", "a  b\n\n c \t\x1c x", "<|endoftext|> hi<|startoftext|>x", "aaaaaaa" * 50, "日本語テキスト ñandú İΣ aΣ", "don't we'll I'VE  123 4567 !!??--- ", "abab" * 2000, " x\x85y", "ﬁ é ​", " a  b"]


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    raw = open(public_tokenizers.path(request.param), encoding="utf-8").read()
    return bpe.Bpe(raw), tokenizers.Tokenizer.from_str(raw)


def test_equals_the_library(pair):
    mine, lib = pair
    enc, count = bpe.Encoder(mine), bpe.Counter(mine)
    r = random.Random(1)
    texts = ODD + ["".join(r.choices("abcdefghijklmnopqrstuvwxyzABCÉéñ   '\n..,,12345-<|>", k=r.randrange(300))) for _ in range(400)]
    texts += ["".join(r.choices("abst he", k=60)) for _ in range(400)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        got = enc(t)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert enc.decode(got) == lib.decode(want, skip_special_tokens=False)
        assert count(t) == len(want)


def test_automaton_on_small_tables():
    """Against the merge procedure itself, for tables where merges overlap."""

    def merged(word, merges):
        parts = list(word)
        for a, b in merges:
            out, i = [], 0
            while i < len(parts):
                if parts[i : i + 2] == [a, b]:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    r = random.Random(2)
    for _ in range(200):
        tokens, merges = list("abc"), []
        for _ in range(r.randrange(1, 9)):
            a, b = r.choice(tokens), r.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        auto = bpe.MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges, None)
        for _ in range(60):
            w = "".join(r.choices("abc", k=r.randrange(1, 14)))
            assert auto.decode(auto.encode(w)) == merged(w, merges), (w, merges)


def test_whole_tokens_are_proved(pair):
    mine, lib = pair
    whole = mine.whole_tokens()
    assert len(whole) > 20_000
    for s in random.Random(3).sample(sorted(whole), 500):
        if len(lib.pre_tokenizer.pre_tokenize_str(s)) == 1 and lib.normalizer is None:
            assert lib.encode(s, add_special_tokens=False).ids == [whole[s]]


def test_proof_does_not_rest_on_the_table_of_strings():
    """A string wrongly taken for a token is not proved, and encodes as the merges have it."""
    small = bpe.MergeAutomaton({"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, [("a", "b"), ("b", "a")], None)
    small.spelt["aba"] = 4
    assert small.encode("aba") == [2, 0] and not small.is_whole("aba") and small.is_whole("ab")


def test_operators(spark, odd_docs, no_docs):
    path = public_tokenizers.path(NAMES[0])
    lib = tokenizers.Tokenizer.from_file(path)
    out = bpe.encode(odd_docs, path, decoded=True).collect()
    want = sorted((str(d.doc_id), lib.encode(d.text or "", add_special_tokens=False).ids) for d in odd_docs.collect())
    assert sorted((str(x.doc_id), np.frombuffer(x.ids, "<u4").tolist()) for x in out) == want
    back = bpe.decode(bpe.encode(odd_docs, path), path).collect()
    assert sorted(x.decoded for x in back) == sorted(lib.decode(i, skip_special_tokens=False) for _, i in want)
    assert bpe.encode(no_docs, path).count() == 0 and bpe.count_tokens(no_docs, path).count() == 0
    counted = {(x.doc_id, x.n_bytes) for x in bpe.count_tokens(odd_docs, path).collect()}
    assert counted == {(d.doc_id, len((d.text or "").encode())) for d in odd_docs.collect()}


def test_queries(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lib = [tokenizers.Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES]
    one, three = queries.op1_bpe(spark, sf).collect(), queries.op3_token_counts(spark, sf).collect()
    assert len(one) == len(three) == len(docs)
    for r in one:
        ids = lib[0].encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib[0].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in three:
        n = len(lib[1].encode(docs[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 512) and r.n_bytes == len((docs[r.doc_id] or "").encode())
