"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, langid, licenses, lm, spelling, warc
from .exact_dedup import exact_dedup
from .jaccard import jaccard_join
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .common import fold_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hex_of(col):
    return F.sha2(col, 256)


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), decoded=True)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        hex_of(F.col("ids")).alias("ids_sha256"),
        hex_of(F.col("decoded").cast("binary")).alias("decoded_sha256"),
    )


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op6_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g ON t.t = g.t
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of_id(F.col("doc_id"), 4) == 2)
    learned = langid.sample(docs.where(~F.col("held_out")), "doc_id", "text", "lang")
    return langid.identify(docs, learned, keep=["held_out"])


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", hex_of(F.col("kept_text").cast("binary")).alias("kept_sha256"))


_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op2_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT doc_id, i, line, {_KEY} AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.i, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1: eight groups of five hexadecimal digits, four letters each.
_B32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '')"""
ORACLE["op10_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT t, max(page_id) AS top FROM p GROUP BY t)
SELECT p.page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN p.page_id = g.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = g.top THEN NULL ELSE g.top END AS refers_to
FROM p JOIN g ON p.t = g.t
"""


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join(table(spark, sf_dir, "documents"), size=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", fold_of_id(F.col("doc_id"), 5) != 1)
    out = lm.score(docs, "train")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


ORACLE["op4_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN m ON s.doc_id = m.doc_id
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: crc32 of text, byte by byte over its hexadecimal form, and the table of the polynomial.
_CRC = """(WITH RECURSIVE x(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM x WHERE k < 8)
  SELECT list(c ORDER BY b) AS tab FROM x WHERE k = 8)"""
ORACLE["op11_spelling_variants"] = rf"""
WITH RECURSIVE tab AS MATERIALIZED {_CRC},
d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+') AS rs FROM documents),
u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(rs), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM d),
o AS (SELECT id, r, count(*) AS n FROM u WHERE length(r) >= 7 GROUP BY ALL),
h AS (SELECT r, n, hex(encode(id || ':' || r)) AS x, tab FROM o, tab),
c AS (SELECT r, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
        lambda s, b: xor(s >> 8, CAST(tab[1 + (xor(s, b) & 255)] AS BIGINT))), 4294967295) AS h FROM h),
e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, 2 + h % length(r)) ELSE r END AS word, n FROM c),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS (SELECT word, n, length(word) AS len, unnest(range(1, length(word) + 1)) AS i FROM w),
g AS (SELECT word, n, len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM v),
p AS (SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM g a JOIN g b ON a.s = b.s AND a.i = b.i AND a.len = b.len AND a.word <> b.word
      UNION SELECT g.word, g.n, w.word, w.n FROM g JOIN w ON g.s = w.word UNION SELECT w.word, w.n, g.word, g.n FROM g JOIN w ON g.s = w.word),
b AS (SELECT a, count(*) AS n_near, first(b ORDER BY nb DESC, b) AS f, max(nb) AS fn FROM p GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN fn >= 10 * n THEN f END AS form, CASE WHEN fn >= 10 * n THEN fn END AS form_n FROM w LEFT JOIN b ON w.word = b.a),
r(word, last) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.last AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f AS z ON z.word = r.last AND z.form IS NULL
"""


@query
def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


ORACLE["op12_minhash_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS sh FROM d),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT lang, source FROM d GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
v AS (SELECT g.lang, count(DISTINCT k.term) AS v FROM g LEFT JOIN k ON g.lang = k.lang GROUP BY ALL),
l AS (SELECT lang, sum(total) AS n FROM k GROUP BY lang),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (n.n + v.v) AS p, 1 + (1000000000 * (k.total + 1)) // (l.n + v.v) AS q
      FROM n JOIN v ON n.lang = v.lang JOIN k ON n.lang = k.lang JOIN l ON n.lang = l.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(CAST(((a.p - b.p) * (a.p - b.p)) // b.p AS HUGEINT)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""
