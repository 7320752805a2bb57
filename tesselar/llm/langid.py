"""Language identification by compression with per-language zstandard raw-content dictionaries.

For each language a bounded sample of labelled texts becomes a raw dictionary. A text is compressed once with each, block
by block over its whole length; the dictionary that makes it smallest names the language. The margin is the share by which
the best size undercuts the second. Texts with a narrow margin get a second opinion from dictionaries made of other texts,
and are rejected if the margin stays narrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidied

#: Bytes of a dictionary; dictionaries a language; labelled rows fetched a language (bounds of the sample, not of the data).
DICT_BYTES = 32_768
OPINIONS = 2
SAMPLE_ROWS = 160
#: Characters of a sampled text that may enter a dictionary.
SAMPLE_CHARS = 4 * DICT_BYTES
_SALTS = 64
#: Bytes compressed at a time: small against the dictionary, so that long texts don't become their own dictionary.
CHUNK = 4096
LEVEL = 6
#: Below this margin the other dictionaries are asked; below the lower one the text is rejected.
NARROW = 0.03
MIN_MARGIN = 0.002
UNKNOWN = "und"
_TO_BLANK = dict.fromkeys(map(ord, "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n\t\r"), " ")


def clean(text: str) -> str:
    """Lower case, without digits, ASCII punctuation and repeated blanks."""
    return " ".join(text.lower().translate(_TO_BLANK).split())


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[bytes]]:
    """Language -> contents of its dictionaries, from labelled rows chosen by a hash of the id.

    Reads ids and labels first and then texts of the chosen ids only: SAMPLE_ROWS a language at most, and of each SAMPLE_CHARS characters,
    so what reaches the driver is bounded by the number of languages. Rows with the same id and label count as one, with the
    largest of their texts; null ids are one id. Copies count once. An empty table, or one without labels, gives an empty result.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(ident.alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    order = F.struct(F.xxhash64("i").alias("h"), "i")
    keys = rows.select("i", "l").distinct().withColumn("s", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(_SALTS)))
    per = -(-SAMPLE_ROWS // _SALTS) * 4
    ranked = keys.withColumn("r", F.row_number().over(Window.partitionBy("l", "s").orderBy(order))).where(F.col("r") <= per)
    top = ranked.withColumn("q", F.row_number().over(Window.partitionBy("l").orderBy("r", "s", order))).where(F.col("q") <= SAMPLE_ROWS)
    ids = sorted({r.i for r in top.select("i").collect()})
    if not ids:
        return {}
    texts = rows.where(F.col("i").isin(ids)).groupBy("l", "i").agg(F.substring(F.max("t"), 1, SAMPLE_CHARS).alias("t")).collect()
    by: dict[str, dict[str, None]] = {}
    for r in sorted((r for r in texts if r.t), key=lambda r: (r.l, -min(len(r.t), 1500), r.t)):
        by.setdefault(r.l, {})[clean(r.t)] = None
    out = {}
    for lang, found in by.items():
        parts = [p for p in found if p]
        out[lang] = [b" ".join(p.encode("utf-8", "surrogatepass") for p in parts[k::OPINIONS])[:DICT_BYTES] or b" " for k in range(OPINIONS)]
    return out


class Classifier:
    def __init__(self, contents: dict[str, list[bytes]]):
        import zstandard

        self.langs = sorted(contents)
        self.opinions = []
        for k in range(OPINIONS):
            made = []
            for lang in self.langs:
                content = contents[lang][k] if len(contents[lang][k]) >= 8 else contents[lang][0].ljust(8)
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
            self.opinions.append(made)

    def sizes(self, data: bytes, k: int) -> list[int]:
        parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum([len(f(p)) for p in parts]) for f in self.opinions[k]]

    def __call__(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
        """Language, margin (0 to 1), rejected. Without a letter, or with nothing learned: unknown, 0, rejected."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = clean(text).encode("utf-8", "surrogatepass")
        sizes = self.sizes(data, 0)
        lang, margin = self._best(sizes)
        for k in range(1, OPINIONS):
            if margin >= NARROW:
                break
            sizes = [a + b for a, b in zip(sizes, self.sizes(data, k))]
            lang, margin = self._best(sizes)
        return lang, margin, margin < min_margin

    def _best(self, sizes: list[int]) -> tuple[str, float]:
        if len(sizes) == 1:
            return self.langs[0], 1.0
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        return self.langs[order[0]], 1.0 - sizes[order[0]] / sizes[order[1]]


def identify(docs: DataFrame, contents: dict[str, list[bytes]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id, ``keep`` columns, lang_pred, score, rejected) of whole texts; a map without a shuffle.

    Null texts and texts without a letter are ``und`` with score 0; ties go to the first language by name and are rejected. Long texts
    are compressed whole. Each row is judged by its text alone, so repeated rows get the same; an empty table gives an empty result.
    Columns in ``keep`` must not be called as those added; all others, whatever they are called, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(contents)  # languages x OPINIONS x DICT_BYTES at most
    keep = [c for c in keep or [] if c != id_col]
    rows = docs.select(F.col(text_col).cast("string").alias("_text_"), id_col, *keep)
    schema = T.StructType([*[rows.schema[c] for c in [id_col, *keep]], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [classify(t, min_margin) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                    names=schema.names,
                )

    return rows.mapInArrow(tidied(run), schema)


def keep_known(docs: DataFrame, contents: dict[str, list[bytes]], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is not rejected, all columns as they were, whatever they are called; a map without a shuffle.

    Null and empty texts, texts without a letter and ties are rejected; long texts are read whole; repeated rows are treated alike; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(contents)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([not classify(t, min_margin)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
