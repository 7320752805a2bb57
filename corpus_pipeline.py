"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written as
Parquet and read again for the next one. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import bpe, decontam, exact_dedup, jaccard, langid
from tesselar.llm.common import Scratch, made, small_batches, sweep, table
from tesselar.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no letter, no text (null or empty), or a margin below MIN_MARGIN, ties included. The
    dictionaries are made of labelled rows of ``docs`` itself; without any, or without rows, nothing is left. Long texts are read whole;
    repeated rows are treated alike."""
    small_batches(spark)
    return langid.keep_known(docs, langid.sample(docs, "doc_id", "text", "lang"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the row with the largest doc_id stays (null ids are the smallest; of repeated rows and ties one).
    Null texts count as empty ones; long texts are compared whole; an empty table stays empty."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by similarities of 0.8 or more on five-word shingles the one with the smallest doc_id stays (null ids come last; of
    repeated rows and ties one). Null and empty texts stay; long texts are read whole; an empty table stays empty."""
    return jaccard.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a test of the benchmark go. Null and empty texts stay; long texts are searched whole; repeated rows and ties
    between tests make no difference; an empty table stays empty."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed as little-endian unsigned 32-bit integers), and digests of ids and decoded text. Null texts count as
    empty ones; long texts are encoded whole; each repeated row has its result; an empty table gives an empty one."""
    out = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("jaccard_join", near), ("decontamination", benchmark), ("bpe", encode)]
#: Compression sizes and automata have no SQL form; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way, and its input, is removed once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = made()
        kept = scratch.save(stage(spark, docs, sf_dir), name)
        sweep(spark, before)
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
