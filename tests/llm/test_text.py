import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tesselar.llm import decontam, langid, licenses, lm, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_language_on_held_out(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet").collect()}
    out = queries.op7_language_id(spark, f"{sf[:-5]}0.01").collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95
    assert sum(r.rejected for r in out) <= 0.01 * len(out)


def test_language_by_brute_force(spark, sf):
    """Each decision recomputed by compressing every block with every dictionary, one call after another."""
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    contents = langid.sample(docs, "doc_id", "text", "lang")

    made = {}

    def size(data, content):
        if content not in made:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            made[content] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(made[content].compress(data[k : k + langid.CHUNK])) for k in range(0, len(data), langid.CHUNK))

    some = docs.where("doc_id % 4 = 0")
    got = {r.doc_id: r for r in langid.identify(some, contents).collect()}
    for r in some.collect():
        x = got[r.doc_id]
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
            continue
        data, sizes = langid.clean(r.text).encode(), dict.fromkeys(contents, 0)
        for k in range(langid.OPINIONS):
            sizes = {lang: n + size(data, contents[lang][k]) for lang, n in sizes.items()}
            best, second = sorted((n, lang) for lang, n in sizes.items())[:2]
            margin = 1 - best[0] / second[0]
            if margin >= langid.NARROW:
                break
        assert (x.lang_pred, x.score, x.rejected) == (best[1], margin, margin < langid.MIN_MARGIN)


def test_language_edges(spark, odd_docs, no_docs):
    contents = langid.sample(odd_docs, "doc_id", "text", "lang")
    assert set(contents) <= {"en", "fr", "de"}
    out = langid.identify(odd_docs, contents, keep=["n"]).collect()
    assert len(out) == odd_docs.count()
    texts = {str(d.doc_id): d.text for d in odd_docs.collect() if d.doc_id is not None}
    for r in out:
        if r.doc_id is not None and not any(map(str.isalpha, texts[str(r.doc_id)] or "")):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    same = odd_docs.selectExpr("cast(null as long) as doc_id", "'eins zwei drei' as text", "'de' as lang").unionByName(odd_docs.selectExpr("1 as doc_id", "text", "'en' as lang"))
    assert set(langid.sample(same, "doc_id", "text", "lang")) == {"de", "en"}  # null ids and repeated ids teach as one row each
    assert langid.sample(no_docs, "doc_id", "text", "lang") == {}
    assert {r.lang_pred for r in langid.identify(odd_docs, {}).collect()} == {"und"}
    assert langid.identify(no_docs, contents).count() == 0
    assert langid.keep_known(odd_docs, contents).columns == odd_docs.columns


def hits_by_hand(text, items):
    """Every alignment of every test, one by one."""
    import string

    def words(t):
        return [w.strip(string.punctuation) or w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))]

    d, out = words(text), set()
    for i, t in items:
        w = words(t)
        for off in range(-len(w) + 1, len(d)):
            same = [0 <= off + k < len(d) and d[off + k] == w[k] for k in range(len(w))]
            a, b = max(0, -off), min(len(w), len(d) - off)
            best = max((e - s for s in range(a, b) for e in range(s + 1, b + 1) if 100 * sum(same[s:e]) >= 80 * (e - s)), default=0)
            if best and best >= min(13, len(w)):
                out.add((i, best))
    return out


def test_masks_find_two_substitutions():
    import itertools

    spans = [[o + i for i, c in enumerate(m) if c == "1"] for m in decontam.MASKS for o in range(14 - len(m))]
    for gone in itertools.combinations(range(13), 2):
        assert any(not set(gone) & set(s) for s in spans)


def test_decontamination(spark, odd_docs, no_docs):
    r = random.Random(6)
    items = [(k, " ".join(f"t{k}w{i}" for i in range(n))) for k, n in enumerate((40, 25, 13, 5, 1))] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(60):
        w = [f"c{r.randrange(50)}" for _ in range(r.randrange(5, 40))]
        if i % 3:
            t = items[r.randrange(4)][1].split()
            a = r.randrange(0, max(1, len(t) - 12))
            t = [x if r.random() < 0.85 else "CHANGED" for x in t[a : a + r.randrange(8, 30)]]
            w[2:2] = [x.upper() + "." for x in t]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.item_id, x.n_words) for x in decontam.overlaps(docs, bench).collect()}
    want = {(i, *h) for i, t in rows for h in hits_by_hand(t, [x for x in items if x[1]])}
    assert got == want
    left = decontam.decontaminate(docs, bench)
    assert sorted(x.doc_id for x in left.collect()) == sorted({i for i, _ in rows} - {x[0] for x in want})
    assert len(list(decontam.blocks(bench, limit=300))) > 1
    assert decontam.overlaps(no_docs, bench).count() == 0 and decontam.overlaps(odd_docs, bench.where("false")).count() == 0
    assert decontam.decontaminate(odd_docs, bench).columns == odd_docs.columns


def test_every_accepted_run_has_a_seed():
    """All substitutions the rule allows, for tests of 1 to 25 words, through the index itself; for 21 and more a sample."""
    import itertools

    r = random.Random(3)
    for n in range(1, 26):
        k = n * (100 - decontam.LEAST_PERCENT) // 100
        index = decontam.Index([(0, " ".join(f"w{i}" for i in range(n)))])
        gone = list(itertools.combinations(range(n), k))
        if n > 20:
            gone = r.sample(gone, 3000)
        held = np.tile(index.words[0], (len(gone), 1))
        for row, g in zip(held, gone):
            row[list(g)] = 7
        got = index.overlaps(held.ravel(), np.arange(len(gone) + 1) * n)
        assert {g[0] for g in got} == set(range(len(gone))), n
        assert all(g[4:] == (n, n - k) for g in got)


def test_overlaps_by_brute_force():
    r = random.Random(8)
    items = [(k, " ".join(f"t{r.randrange(9)}" if r.random() < 0.2 else f"t{k}w{i}" for i in range(n))) for k, n in enumerate([*range(1, 23), 30, 41])]
    texts = []
    for _ in range(300):
        w = []
        for _ in range(r.randrange(1, 4)):
            t = r.choice(items)[1].split()
            a = r.randrange(0, max(1, len(t) - 12))
            w += [f"c{r.randrange(9)}" for _ in range(r.randrange(4))] + [x if r.random() < 0.82 else "CHANGED" for x in t[a : a + r.randrange(5, 45)]]
        texts.append(" ".join(w))
    index = decontam.Index(items)
    got = {(g[0], index.ids[g[1]], g[4]) for g in decontam._scan(texts, index, decontam._Hash())}
    assert got == {(i, *h) for i, t in enumerate(texts) for h in hits_by_hand(t, items)}


def test_leaks_are_found_and_clean_documents_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 8]) for _, t in items for w in [t.lower().split()] for k in range(len(w) - 7)}
    want = {d.doc_id for d in docs for w in [d.text.lower().split()] if any(tuple(w[k : k + 8]) in grams for k in range(len(w) - 7))}
    assert {r.doc_id for r in queries.op9_decontamination(spark, sf).collect()} == want and want


def test_longest_run():
    r = random.Random(1)
    for _ in range(200):
        same = np.array([r.random() < 0.7 for _ in range(r.randrange(1, 25))])
        best = max((e - s for s in range(len(same)) for e in range(s + 1, len(same) + 1) if 100 * same[s:e].sum() >= 80 * (e - s)), default=0)
        at, n = decontam.longest_run(same, 80)
        assert n == best and 100 * same[at : at + n].sum() >= 80 * n


def test_difference():
    assert licenses.difference(["a", "b", "c"], ["x", "a", "b", "c", "y"]) == (0, 1, 4)
    assert licenses.difference(["a", "b", "c"], ["a", "z", "c"])[0] == 1
    assert licenses.difference(["a"], [])[0] == 1


def plain_difference(template, block):
    """Fewest edits against any part, cell by cell."""
    row = [0] * (len(block) + 1)
    for i, w in enumerate(template):
        new = [i + 1]
        for j, b in enumerate(block):
            new.append(min(row[j] + (w != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_difference_against_cells():
    r = random.Random(7)
    for _ in range(300):
        t = [r.choice("abcd") for _ in range(r.randrange(1, 9))]
        b = [r.choice("abcde") for _ in range(r.randrange(0, 14))]
        cost, start, end = licenses.difference(t, b)
        assert cost == plain_difference(t, b)
        if start < end:
            whole = [list(range(end - start + 1))]
            for i, w in enumerate(t):
                new = [i + 1]
                for j, x in enumerate(b[start:end]):
                    new.append(min(whole[-1][j] + (w != x), whole[-1][j + 1] + 1, new[j] + 1))
                whole.append(new)
            assert whole[-1][-1] == cost


def test_license_rows_by_hand(spark, sf):
    """Position, differences and saving of each row, recomputed from the text."""
    import zstandard

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op8_license_scan(spark, sf).collect()
    assert out
    for r in out:
        block, found = licenses.words(docs[r.doc_id][r.start : r.end]), []
        for t in map(licenses.words, licenses.TEMPLATES[r.license]):
            if len(t) == r.n_template_words and plain_difference(t, block) == r.n_different and licenses.deciding(t) == licenses.deciding(block):
                data = " ".join(block).encode()
                d = zstandard.ZstdCompressionDict(" ".join(t).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                with_dict = zstandard.ZstdCompressor(level=licenses.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(data)
                found.append(1 - len(with_dict) / len(zstandard.ZstdCompressor(level=licenses.LEVEL, write_content_size=False).compress(data)))
        assert any(math.isclose(r.saved, x, abs_tol=0.02) for x in found), r


GNU = "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{sep} either version {v} of the License, or (at your option) any later version."


def test_licenses_that_read_alike():
    scanner = licenses.Scanner()
    names = lambda t: [g[0] for g in scanner(t)]
    for kind, v, name in (("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")):
        for what in ("program", "library"):
            for sep in (";", ","):
                assert names(GNU.format(what=what, sep=sep, kind=kind, v=v)) == [f"{name}-or-later"], (kind, v)
    assert names(GNU.format(what="program", sep=";", kind="", v="4")) == [] and names("Licensed under the XYZ License.") == []
    three = licenses.TEMPLATES["BSD-3-Clause"][1]
    two = licenses.TEMPLATES["BSD-2-Clause"][1]
    for text, name in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause")):
        text = text.replace(" 1. ", "\n\n* ").replace(" 2. ", "\n\n* ").replace(" 3. ", "\n\n* ").replace(" THIS", "\n\nTHIS").replace("holder", "owner")
        assert names("Copyright (c) 2020, X. All rights reserved.\n\n" + text) == ["Proprietary", name]
    assert names(licenses.TEMPLATES["ISC"][1]) == ["ISC"] and names(licenses.TEMPLATES["0BSD"][0]) == ["0BSD"]
    for name in ("MIT", "Apache-2.0", "GPL-2.0-or-later", "LGPL-2.1-only", "BSD-2-Clause"):
        assert names(f"# SPDX-License-Identifier: {name}\nimport os\n") == [name]
    for text, found in (
        ("MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("(GPL-2.0-or-later AND BSD-3-Clause) OR ISC", ["GPL-2.0-or-later", "BSD-3-Clause", "ISC"]),
        ("GPL-2.0 WITH Linux-syscall-note OR MIT", ["GPL-2.0", "MIT"]),
        ("MIT OR -", ["MIT"]),
        ("MIT OR\nApache-2.0", ["MIT"]),
    ):
        assert names(f"// SPDX-License-Identifier: {text}\n") == found, text
    seven = ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "MPL-2.0", "ISC"]
    assert names(" ".join(["Parts of it:", *(licenses.TEMPLATES[n][0] for n in seven)])) == seven


def test_licenses(spark, sf, odd_docs, no_docs):
    scanner = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            got = scanner("Some words before.\n" + t + "\nAnd after it.")
            assert [g[0] for g in got] == [name] and got[0][4] == 0, (t, got)
    assert [g[:1] + g[4:5] for g in scanner("X. Licenced under the Apache License, version 2.0!")] == [("Apache-2.0", 1)]
    for clean in ("He had a driving licence and a fishing license.", "no cue at all", "", None):
        assert scanner(clean) == []
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op8_license_scan(spark, sf).collect()
    cue = re.compile(r"licensed under|released under the mit|all rights reserved", re.I)
    assert {r.doc_id for r in out} == {i for i, t in docs.items() if cue.search(t)}
    for r in out:
        assert 0 <= r.start < r.end <= len(docs[r.doc_id])
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0


def test_wrapped_licenses():
    """Every template wrapped at 60 to 80 columns, in comments and between other words, and two of it in a paragraph."""
    import textwrap

    scanner = licenses.Scanner()
    prose = "the quick brown fox jumps over some lazy dogs while seven small boats sail past an old harbour wall in autumn rain".split()
    r = random.Random(2)
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            for width in range(60, 81, 4):
                for prefix in ("", " * ", "# ", "// ", ";; "):
                    for before in (0, 9, 70):
                        text = " ".join([*r.choices(prose, k=before), t, *r.choices(prose, k=before)])
                        text = "\n".join(textwrap.wrap(text, width, initial_indent=prefix, subsequent_indent=prefix))
                        got = scanner(text)
                        assert [g[0] for g in got] == [name] and got[0][4] == 0, (t, width, prefix, before, got)
                        assert licenses.words(text[got[0][1] : got[0][2]]) == licenses.words(t)
            got = scanner(textwrap.fill(" ".join([t, *r.choices(prose, k=5), t])))
            assert [(g[0], g[4]) for g in got] == [(name, 0)] * 2, (t, got)
    changed = licenses.TEMPLATES["MIT"][2].replace("charge", "cost").replace("person", "party").replace("merge, ", "").replace("persons", "people")
    assert [g[0] for g in scanner(textwrap.fill(changed, 77).replace("\n", "\r\n"))] == ["MIT"]


def test_exchange_finds_classes():
    """Words of two kinds that alternate end up in two classes."""
    n = 12
    big = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            if a % 2 != b % 2:
                big[a, b] = 5 + (a * b) % 3
    of = lm.exchange(big[np.ix_(*[list(range(0, n, 2)) + list(range(1, n, 2))] * 2)], 2)
    assert len(set(of[: n // 2])) == 1 and len(set(of[n // 2 :])) == 1 and of[0] != of[-1]


def check_scores(rows, out):
    tokens = [(i, tr, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None]) for i, tr, t in rows]
    c = Counter(w for _, tr, ws in tokens if tr for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, _, ws in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want


def test_lm(spark, sf, odd_docs, no_docs):
    docs = odd_docs.selectExpr("*", "coalesce(doc_id, 0) % 3 <> 1 as train")
    out = lm.score(docs, "train").collect()
    check_scores([(d.doc_id, d.train, d.text) for d in docs.collect()], out)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lm.score(no_docs.selectExpr("doc_id", "text", "true as train"), "train").count() == 0
    untrained = lm.score(odd_docs.selectExpr("doc_id", "text", "false as train"), "train").collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untrained)


def test_lm_head_does_not_change_classes(spark, sf, monkeypatch):
    """Words that are not broadcast get the class they would have in the head, so scores do not depend on HEAD."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 5 <> 1 as train")
    monkeypatch.setattr(lm, "CORE", 60)
    want = {r.doc_id: r for r in lm.score(docs, "train").collect()}
    for head in (61, 150):
        monkeypatch.setattr(lm, "HEAD", head)
        got = {r.doc_id: r for r in lm.score(docs, "train").collect()}
        assert got.keys() == want.keys()
        for i, r in want.items():
            assert math.isclose(got[i].score, r.score, rel_tol=1e-9) and math.isclose(got[i].base_score, r.base_score, rel_tol=1e-9)
            assert got[i].n_known == r.n_known


def test_lm_score_by_hand(spark, sf, monkeypatch):
    """Class bigrams by hand from the classes alone; probabilities of all words, known or not, and the end sum to 1."""
    from tesselar.llm.common import Scratch

    monkeypatch.setattr(lm, "CORE", 80)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 5 <> 1 as train")
    rows = [(r.doc_id, r.train, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(FOLD))) for r in docs.collect()]
    known = lm.train(docs.where("train").selectExpr("coalesce(text, '') as text"), Scratch(spark, "t"))
    learned = {w.decode(): int(known.of[i]) for w, i in known.head.items()} | {bytes(r.word).decode(): r.k for r in known.others.where("k is not null").collect()}
    c = Counter(w for _, tr, ws in rows if tr for w in ws)
    assert {w for w, n in c.items() if n >= lm.LEAST_HEAD} == set(learned)
    end, of = lm._END, lambda w: learned.get(w, lm.CLASSES + zlib.crc32(w.encode()[-2:]) % lm.TAILS)
    step, total = Counter(), Counter()
    for _, tr, ws in rows:
        if tr:
            ks = [end, *map(of, ws), end]
            step.update(zip(ks, ks[1:]))
    for (_, b), n in step.items():
        total[b] += n
    out, tails = Counter(), Counter(of(w) for w in c if w not in learned)
    for (a, _), n in step.items():
        out[a] += n
    everything = sum(total.values())
    share = {k: (total[k] + 0.5) / (everything + 0.5 * (end + 1)) for k in range(end + 1)}
    move = lambda a, b: (step[a, b] + lm.SMOOTH * share[b]) / (out[a] + lm.SMOOTH)
    emit = lambda w: c[w] / total[of(w)] if w in learned else (c[w] + 0.5) / (total[of(w)] + 0.5 * (tails[of(w)] + 1))
    got = {r.doc_id: r.score for r in lm.score(docs, "train").collect()}
    for i, _, ws in rows:
        ks = [end, *map(of, ws), end]
        want = sum(math.log10(move(a, b)) for a, b in zip(ks, ks[1:])) + sum(math.log10(emit(w)) for w in ws)
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9)
    mass = Counter()
    for w in c:
        mass[of(w)] += emit(w)
    for t in range(lm.CLASSES, end):
        mass[t] += 0.5 / (total[t] + 0.5 * (tails[t] + 1))  # all words that were not seen
    assert all(math.isclose(m, 1) for k, m in mass.items() if total[k])
    assert all(math.isclose(sum(move(a, b) for b in range(end + 1)), 1) for a in range(end + 1))


def test_lm_query(spark, sf):
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 != 1, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op5_lm_score(spark, sf).collect()
    check_scores(rows, out)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
