"""BPE encoding and decoding by a tokenization automaton, and token counts by the whole-token shortcut.

The automaton is built by one gadget a merge rule. It starts as one state whose arcs are the base symbols. The rule
(u, v) adds, for the merged token uv:

* a state, copied from the state that v leads to (what may follow uv is what could follow v at that moment),
* an arc labelled uv from every state that then had an arc u,
* and removes the arc v from the state that u leads to.

Every arc labelled t leads to the state of t, so a state is named by its token. Copies share what they copied: a state
keeps its origin (``right``), the time of the copy (``rank``) and the arcs removed from it (``cut``); an arc's presence
is read off by following these links back in time, and is then kept in the transition table. A text has one path of
arcs whose labels spell it, and this path is the merge procedure's result. Encoding walks it with the longest label
first; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidied

#: Words and pieces kept with their result, a Python worker.
CACHE = 100_000
_END = 0xE000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """The deterministic automaton of one merge table; ``suffix`` marks a word's last symbol, if the vocabulary does so."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str | None):
        size = max(vocab.values(), default=-1) + 1
        self.suffix = suffix or ""
        self.label = [""] * size
        for token, i in vocab.items():
            self.label[i] = token
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}
        self.size = size
        self.used = [True] * size
        self.rules: dict[int, tuple[int, int]] = {}
        for time, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)
            self.rules.setdefault(vocab[a] * size + vocab[b], (time, vocab[a + b]))
        self.spelt: dict[str, int] = {}
        made = [i for i in range(size) if self.used[i] and (self.rank[i] >= 0 or self._is_base(self.label[i]))]
        for i in made:
            self.spelt[self._symbols(self.label[i])] = i
        self.trie: dict = {}
        for s, i in self.spelt.items():
            node = self.trie
            for c in s:
                node = node.setdefault(c, {})
            node[""] = i
        self.length = [0] * size
        self.shorter = [-1] * size
        for s, i in self.spelt.items():
            self.length[i] = len(s)
            self.shorter[i] = next((self.spelt[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.spelt), -1)
        self.reach = max(self.length, default=0)
        self.arcs: dict[int, bool] = {}
        self.proved: dict[str, bool] = {}

    def merged(self, s: str) -> list[int]:
        """The ids of a short string of symbols by the plain merge procedure, without the automaton."""
        path, rules, size = [self.spelt[c] for c in s], self.rules, self.size
        while len(path) > 1:
            best = min((rules[k] for k in (a * size + b for a, b in zip(path, path[1:])) if k in rules), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(path):
                if i + 1 < len(path) and rules.get(path[i] * size + path[i + 1]) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(path[i])
                    i += 1
            path = out
        return path

    def is_whole(self, s: str) -> bool:
        """Whether a vocabulary string is proved, by the merge procedure, to end as its own token."""
        found = self.proved.get(s)
        if found is None:
            found = self.proved[s] = self.merged(s) == [self.spelt[s]]
        return found

    def _is_base(self, label: str) -> bool:
        return len(label) == 1 or bool(self.suffix) and len(label) == 1 + len(self.suffix) and label.endswith(self.suffix)

    def _symbols(self, label: str) -> str:
        """A label with one character a symbol; a marked last symbol becomes a private character."""
        if self.suffix and label.endswith(self.suffix):
            return self.word(label[: -len(self.suffix)])
        return label

    def word(self, s: str) -> str:
        """A whole word as the automaton reads it."""
        return s[:-1] + chr(_END + ord(s[-1])) if self.suffix and s else s

    def _gadget(self, u: int, v: int, uv: int, time: int) -> None:
        if self.rank[uv] < 0:
            # without an arc v in the state of u there is no path to relabel: the rule never applies
            self.used[uv] = self.used[u] and self.used[v] and self._had_arc(u, v, time)
            self.left[uv], self.right[uv], self.rank[uv] = u, v, time
        self.cut.setdefault(u * self.size + v, time)

    def _had_arc(self, x: int, t: int, time: int) -> bool:
        """Whether the state of x had an arc t before the rule ``time``."""
        left, right, rank, cut, size = self.left, self.right, self.rank, self.cut, self.size
        while True:
            if cut.get(x * size + t, time) < time:
                return False
            a, b = rank[x], rank[t]
            if a < 0 and b < 0:
                return True
            if b > a:
                if left[t] == right[t] == x:  # three in a row: the first two merge
                    return False
                time, t = b, left[t]
            elif a > b:
                time, x = a, right[x]
            else:
                time, x, t = a, right[x], left[t]

    def arc(self, x: int, t: int) -> bool:
        key = x * self.size + t
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) > 2 * CACHE:
                self.arcs.clear()
            found = self.arcs[key] = self._had_arc(x, t, 1 << 60)
        return found

    def _longest(self, s: str, i: int) -> int:
        node, best = self.trie, -1
        for c in s[i : i + self.reach]:
            node = node.get(c)
            if node is None:
                return best
            best = node.get("", best)
        return best

    def encode(self, s: str) -> list[int]:
        """The ids of a string of symbols (see ``word``)."""
        n = len(s)
        whole = self.spelt.get(s)
        if whole is not None:
            return [whole] if self.is_whole(s) else self.merged(s)
        size, arcs, lengths = self.size, self.arcs, self.length
        path: list[int] = []
        dead = bytearray(n + 1)
        i, t = 0, self._longest(s, 0)
        while i < n:
            while t >= 0:
                j = i + lengths[t]
                if not dead[j]:
                    if not path:
                        break
                    ok = arcs.get(path[-1] * size + t)
                    if ok or ok is None and self.arc(path[-1], t):
                        break
                t = self.shorter[t]
            if t >= 0:
                path.append(t)
                i = j
                t = self._longest(s, i) if i < n else -1
            else:
                if not path:
                    raise ValueError("no path: a symbol is not in the vocabulary")
                dead[i] = 1
                t = path.pop()
                i -= lengths[t]
                t = self.shorter[t]
        return path

    def decode(self, ids: list[int]) -> list[str]:
        return [self.label[i] for i in ids]


class Bpe:
    """A tokenizer file of the ``tokenizers`` library run by the automaton; the library's own normaliser and splitter serve
    only texts with characters beyond Latin, where the Unicode versions of libraries may differ."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        self.raw = raw
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.auto = MergeAutomaton(model["vocab"], self.merges, model.get("end_of_word_suffix"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = dict(enumerate(self.auto.label)) | {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lowers = spec.get("normalizer") is not None
        self.bytes_back = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.byte = byte_symbols()
        self.unbyte = {c: b for b, c in enumerate(self.byte)}
        self.odd = re.compile("[\x1c-\x1fɐ-\U0010ffff]")
        self.unit = re.compile(r" ?\S+|\s+(?!\S)|\s+")
        self._library = None

    def library(self):
        if self._library is None:
            import tokenizers

            spec = json.loads(self.raw)  # without the vocabulary: only the normaliser and the splitter are asked
            bare = {"type": "BPE", "vocab": {}, "merges": []}
            self._library = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": bare, "added_tokens": [], "post_processor": None}))
        return self._library

    def splitter(self):
        import regex

        if self.lowers:
            return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def units(self, text: str) -> tuple[list[str], bool]:
        """Parts no pre-token crosses, and whether they still have to be split into pre-tokens."""
        if self.odd.search(text):
            if self.lowers:
                text = self.library().normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library().pre_tokenizer.pre_tokenize_str(text)], False
        if self.lowers:
            return text.lower().split(), True
        return self.unit.findall(text), True

    def symbols(self, piece: str) -> str:
        byte = self.byte
        if piece.isascii() and piece.isprintable():
            return self.auto.word(byte[32] + piece[1:] if piece[0] == " " and " " not in piece[1:] else piece.replace(" ", byte[32]))
        return self.auto.word("".join([byte[b] for b in piece.encode("utf-8", "surrogatepass")]))

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn."""
        if self.cut is not None and "<|" in text or any(not s.startswith("<|") for s in self.special):
            return self.cut.split(text)
        return [text]

    def whole_tokens(self) -> dict[str, int]:
        """Pre-tokens proved to encode alone as one token: each vocabulary string is merged by the plain procedure once."""
        proved = {}
        for s, i in self.auto.spelt.items():
            if self.auto.is_whole(s):
                label = self.label[i]
                if self.auto.suffix:
                    if not label.endswith(self.auto.suffix):
                        continue
                    label = label[: -len(self.auto.suffix)]
                try:
                    proved[bytes(self.unbyte[c] for c in label).decode("utf-8")] = i
                except UnicodeDecodeError:
                    continue
        return proved


class _Kept(dict):
    """Results of units seen before. When full, the units not used since the last time are forgotten."""

    def __init__(self, bpe: Bpe, split: bool):
        super().__init__()
        self.bpe, self.pattern, self.old = bpe, bpe.splitter() if split else None, {}

    def __missing__(self, unit: str):
        out = self.old.get(unit)
        if out is None:
            out = self.make(self.pattern.findall(unit) if self.pattern and not unit.isalpha() else [unit])
        if len(unit) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[unit] = out
        return out


class _Encoded(_Kept):
    """Unit -> its ids as packed little-endian 32-bit integers."""

    def make(self, pieces: list[str]) -> bytes:
        encode, symbols = self.bpe.auto.encode, self.bpe.symbols
        if len(pieces) == 1:
            return np.array(encode(symbols(pieces[0])), "<u4").tobytes()
        return np.array([i for p in pieces for i in encode(symbols(p))], "<u4").tobytes()


class Encoder:
    def __init__(self, bpe: Bpe):
        self.bpe, self.split, self.plain = bpe, _Encoded(bpe, True), _Encoded(bpe, False)

    def __call__(self, text: str | None) -> bytes:
        out: list[bytes] = []
        for part in self.bpe.segments(text or ""):
            if part in self.bpe.special:
                out.append(np.array([self.bpe.special[part]], "<u4").tobytes())
            elif part:
                units, split = self.bpe.units(part)
                out.extend(map((self.split if split else self.plain).__getitem__, units))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        labels = list(map(self.bpe.label.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        if not self.bpe.bytes_back:
            return " ".join(labels)
        unbyte, out = self.bpe.unbyte, bytearray()
        for s in labels:
            if all(c in unbyte for c in s):
                out += bytes(map(unbyte.__getitem__, s))
            else:
                out += s.encode("utf-8")
        return out.decode("utf-8", "replace")


class _Counted(_Kept):
    """Unit -> number of its tokens. Proved whole tokens count one without a merge; only the rest is merged."""

    def __init__(self, bpe: Bpe, split: bool, whole: dict[str, int]):
        super().__init__(bpe, split)
        self.whole = whole

    def make(self, pieces: list[str]) -> int:
        bpe, whole, n = self.bpe, self.whole, 0
        for p in pieces:
            n += 1 if p in whole else len(bpe.auto.encode(bpe.symbols(p)))
        return n


class Counter:
    def __init__(self, bpe: Bpe):
        whole = bpe.whole_tokens()
        self.bpe, self.split, self.plain = bpe, _Counted(bpe, True, whole), _Counted(bpe, False, whole)
        self.split.update(dict.fromkeys((w for w in whole if re.fullmatch(" ?[A-Za-z]+", w) and len(bpe.splitter().findall(w)) == 1), 1))

    def __call__(self, text: str | None) -> int:
        n = 0
        for part in self.bpe.segments(text or ""):
            if part in self.bpe.special:
                n += 1
            elif part:
                units, split = self.bpe.units(part)
                n += sum(map((self.split if split else self.plain).__getitem__, units))
        return n


_LOADED: dict[tuple[int, type], object] = {}


def _loaded(raw: str, kind: type):
    """One automaton a worker process and tokenizer."""
    key = (hash(raw), kind)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(Bpe(raw))
    return _LOADED[key]


def _source(spark, path: str):
    """The tokenizer file read on the driver and broadcast: its size is that of a vocabulary, not of the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids, decoded?): ids packed as little-endian unsigned 32-bit integers; with ``decoded`` also their decoded text.

    A map over batches without a shuffle. Null and empty texts give no ids. Rows keep their number, repeated ids and null
    ids included; other columns are not read, so names cannot clash. Texts of any length are encoded whole. Nothing is chosen between rows,
    so there are no ties; an empty table gives an empty result.
    """
    raw = _source(docs.sparkSession, path)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _loaded(raw.value, Encoder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [enc(t) for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(pa.array([enc.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), T.StructType(fields))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, decoded) of packed ids: the labels of the arcs, put together as the tokenizer does.

    Null ids give null, empty ones an empty text; lists of any length are decoded whole. Rows keep their number, repeated ids and null ids
    of documents included; other columns are not read; an empty table gives an empty result. An id that the vocabulary lacks is an error."""
    raw = _source(encoded.sparkSession, path)
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _loaded(raw.value, Encoder)
        for batch in batches:
            out = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=schema.names)

    return encoded.select(id_col, "ids").mapInArrow(tidied(run), schema)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of whole texts; null and empty texts have none of either. One map without a shuffle.

    Texts of any length are counted whole. Rows keep their number, repeated ids and null ids included; other columns, whatever they are
    called, are not read; an empty table gives an empty result."""
    raw = _source(docs.sparkSession, path)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _loaded(raw.value, Counter)
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=schema.names)

    text = F.col(text_col).cast("string")
    return docs.select(id_col, text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b")).mapInArrow(tidied(run), schema)
