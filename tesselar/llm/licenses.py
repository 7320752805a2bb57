"""License scans by conditional compression.

A cue of a license notice may be any of its words. The block searched for a template is therefore the cue's paragraph (for templates of
several paragraphs the whole text) as far as the template, with all differences allowed, can reach to both sides, whatever lines and
comment signs it is wrapped in. The candidate is the part of it that reads most like the template: the fewest words to insert, delete or
replace, with the cue in it. It is compressed alone and with the template as zstandard raw dictionary, and confirmed if it has few
differences, none of them in words that tell licenses apart (names, versions, "lesser", "endorse"), and gets enough smaller. All templates
are tried; a stretch of words goes to the one that explains most of it.

Notices, and not the whole text, stand for the long licenses (GNU, Apache, MPL, EPL, Creative Commons), and so does the permission for MIT.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidied

_GNU = "under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{sep} either version {v} of the License, or (at your option) any later version."
_ONLY = "you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License version {v} as published by the Free Software Foundation."
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_CLAUSES = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
_UNLESS = " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."

#: The usual wording of public license notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE, _APACHE + _UNLESS],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "BSD": [_CONDITIONS, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _CONDITIONS + _CLAUSES + _AS_IS],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", _CONDITIONS + _CLAUSES + _NAMES + _AS_IS],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "Proprietary": ["All rights reserved."],
}
for _name, _kind, _v, _what in (("GPL-2.0", "", "2", "program"), ("GPL-3.0", "", "3", "program"), ("AGPL-3.0", "Affero ", "3", "program"), ("LGPL-2.1", "Lesser ", "2.1", "library"), ("LGPL-3.0", "Lesser ", "3", "library")):
    TEMPLATES[f"{_name}-or-later"] = [f"This {_what} is free software: you can redistribute it and/or modify it {_GNU.format(kind=_kind, sep=',', v=_v)}"]
    TEMPLATES[f"{_name}-only"] = [f"This {_what} is free software; {_ONLY.format(kind=_kind, v=_v)}"]
for _code, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    TEMPLATES[f"CC-{_code}-4.0"] = [f"Licensed under CC {_code} 4.0.", f"This work is licensed under a Creative Commons {_long} 4.0 International License."]
for _name in TEMPLATES:
    if _name not in ("BSD", "Proprietary"):
        TEMPLATES[_name] = [*TEMPLATES[_name], f"SPDX-License-Identifier: {_name}"]

CUES = ("licens", "licenc", "rights reserved", "creative commons", "permission is hereby", "permission to use", "permission is granted", "redistribution and use", "free software", "public domain")
#: Words that tell licenses apart, as are versions: a part in which they are others than the template's is another license.
DECIDING = frozenset("mit apache gnu lesser affero isc bsd bsd-style mozilla eclipse unencumbered later endorse 2-clause 3-clause cc0 attribution".split()) | {f"by{x}" for x in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd")}
#: Templates of more words than this may have several paragraphs.
_LONG = 60
_VERSION = re.compile(r"v?(\d+(?:\.\d+)+)$")
#: A winner needs this share of size saved; confirmed blocks differ in at most this share of the template's words.
LEAST_SAVED, MOST_DIFFERENT = 0.25, 0.2
LEVEL = 19
_WORD = re.compile(r"[^\W_]+(?:(?:\.|-(?:[ \t]*\r?\n[^\w\n]*)?)[^\W_]+)*")
_WRAPPED = re.compile(r"-[^\w]+")
_BLANK = re.compile(r"\n[ \t\r\f\v]*\n")
_CUE = re.compile("|".join(c.replace(" ", r"[\W_]+") for c in CUES))
#: An expression of several SPDX identifiers.
_SPDX = re.compile(r"spdx-license-identifier:[ \t(]*[\w.+-]+(?:[ \t()]+(?:or|and|with)[ \t(]+[^\W_][\w.+-]*)+")
_JOINED = re.compile(r"[ \t()](?:or|and)[ \t(]+([^\W_][\w.+-]*)")
#: A word of each cue, to pass over most texts quickly.
_RARE = tuple({max(c.split(), key=len) for c in CUES})


def _tokens(low: str) -> tuple[list[str], list[int], list[int]]:
    """Words, with those broken after a hyphen at a line's end joined, and where they start and end."""
    found = list(_WORD.finditer(low))
    return [_WRAPPED.sub("-", m.group()) if "\n" in m.group() else m.group() for m in found], [m.start() for m in found], [m.end() for m in found]


def words(text: str) -> list[str]:
    return _tokens(text.lower())[0]


def _costs(template: np.ndarray, block: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Last row of the edit table of two texts, whose first row is ``cost``."""
    steps = np.arange(len(block) + 1)
    for w in template:
        new = cost + 1
        new[1:] = np.minimum(new[1:], cost[:-1] + (block != w))
        cost = np.minimum.accumulate(new - steps) + steps  # words inserted after a cheaper place
    return cost


def difference(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """Fewest word edits between the template and any part of the block, and that part's first word and end (of equal ones the
    first to end, and then the shortest)."""
    number: dict[str, int] = {}
    t = np.array([number.setdefault(w, len(number)) for w in template], np.int64)
    b = np.array([number.setdefault(w, len(number)) for w in block], np.int64)
    cost = _costs(t, b, np.zeros(len(b) + 1, np.int64))
    end = int(np.argmin(cost))
    back = _costs(t[::-1], b[:end][::-1], np.arange(end + 1))
    return int(cost[end]), end - int(np.argmin(back)), end


def deciding(tokens: list[str] | tuple[str, ...]) -> Counter:
    """The words that tell licenses apart, with versions without "v" and trailing zeros."""
    out = Counter(w for w in tokens if w in DECIDING)
    out.update(m.group(1).removesuffix(".0") for w in tokens if (m := _VERSION.match(w)))
    out.update(w for before, w in zip(tokens, tokens[1:]) if before in ("version", "v") and w.isdigit())
    return out


def lower(text: str) -> str:
    """The text in lower case, of the same length (a few letters would change it)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def candidates(low: str, starts: list[int]) -> list[tuple[int, int, int]]:
    """(word with a cue, first word and end of its paragraph) for each cue, in order."""
    breaks = [m.start() for m in _BLANK.finditer(low)]
    out = {}
    for m in _CUE.finditer(low):
        k = bisect_right(breaks, m.start())
        begin = bisect_left(starts, breaks[k - 1]) if k else 0
        end = bisect_left(starts, breaks[k]) if k < len(breaks) else len(starts)
        out[bisect_right(starts, m.start()) - 1] = (begin, end)
    return [(i, *span) for i, span in sorted(out.items())]


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        self.known = []
        for name, texts in (templates or TEMPLATES).items():
            for t in texts:
                known = words(t)
                d = zstandard.ZstdCompressionDict(" ".join(known).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.known.append((name, known, Counter(known), int(MOST_DIFFERENT * len(known)), deciding(known), zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress))
        self.cache: dict[tuple, tuple | None] = {}

    def block(self, k: int, tokens: tuple[str, ...], cue: int) -> tuple[float, int, int, int] | None:
        """(saved, differences, first word, end) of the best reading of template ``k`` that has word ``cue`` of the block in it."""
        _, template, bag, most, decide, compress = self.known[k]
        if sum((bag & Counter(tokens)).values()) < len(template) - most:  # each of its words that is not there is a difference
            return None
        if (k, tokens, cue) in self.cache:
            return self.cache[k, tokens, cue]
        found, low, high = None, 0, len(tokens)
        while low <= cue < high:
            edits, a, b = difference(template, tokens[low:high])
            if edits > most:
                break
            a, b = a + low, b + low
            if a <= cue < b:
                data = " ".join(tokens[a:b]).encode("utf-8", "surrogatepass")
                saved = 1 - len(compress(data)) / len(self.alone(data))
                found = (saved, edits, a, b) if saved >= LEAST_SAVED and deciding(tokens[a:b]) == decide else None
                break
            low, high = (low, a) if a > cue else (max(b, low + 1), high)  # another notice, which has its own cue
        if len(self.cache) > 20_000:
            self.cache.clear()
        self.cache[k, tokens, cue] = found
        return found

    def __call__(self, text: str | None) -> list[tuple[str, int, int, float, int, int]]:
        """(license, start, end, saved, differences, template's words) with positions in characters, in order."""
        if not text:
            return []
        low = lower(text)
        if not any(c in low for c in _RARE) or not _CUE.search(low):
            return []
        tokens, starts, ends = _tokens(low)
        found = set()
        for cue, begin, end in candidates(low, starts):
            for k, (name, template, _, most, _, _) in enumerate(self.known):
                reach = len(template) + most
                first, last = (0, len(tokens)) if len(template) > _LONG else (begin, end)
                a, b = max(first, cue - reach), min(last, cue + reach + 1)
                got = self.block(k, tuple(tokens[a:b]), cue - a)
                if got:
                    found.add((name, len(template), *got[:2], got[2] + a, got[3] + a))
        for at in (m.start() + x.start(1) for m in _SPDX.finditer(low) for x in _JOINED.finditer(m.group())):
            i = bisect_left(starts, at)  # an identifier after the first is read as if it stood alone
            for k, (name, template, *_) in enumerate(self.known):
                got = self.block(k, ("spdx-license-identifier", tokens[i]), 0)
                if got:
                    found.add((name, len(template), *got[:2], i, i + 1))
        out, taken = [], set()
        for name, n, saved, edits, a, b in sorted(found, key=lambda x: (x[3] - x[1], x[3], -x[2], x[0], x[4])):
            if taken.isdisjoint(range(a, b)):  # one license a stretch of words: that with most words as they should be
                out.append((name, starts[a], ends[b - 1], saved, edits, n))
                taken.update(range(a, b))
        return sorted(out, key=lambda x: x[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a confirmed notice: id, license, start, end, saved, n_different, n_template_words.

    Documents without a notice have no row; null and empty texts have none. A map without a shuffle over whole texts; rows with
    equal or null ids each give their own rows, other columns, whatever they are called, are not read; an empty table gives no row. Of
    templates that explain as many words of a stretch the one with fewer differences wins, then the larger saving, then the name. Of an
    SPDX expression each license has its row, exceptions after WITH have none.
    """
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL("license string, start int, end int, saved double, n_different int, n_template_words int")])
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(i, x) for i, t in enumerate(batch.column(1).to_pylist()) for x in scanner(t)]
            ids = batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for _, x in rows], kind) for k, kind in enumerate(kinds))], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), schema)
