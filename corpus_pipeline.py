"""A corpus pipeline of five stages; each writes its rows as Parquet for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import byte_bpe, decontamination, language_id, line_dedup, queries, superminhash
from fleetlens.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SURE = 0.5  # posterior below which a language is rejected


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; ``lang`` becomes the prediction. Null texts, texts without a letter and unsure ones go."""
    queries.prepare(spark)
    model = language_id.fit(docs, queries.RANKS, F.expr(f"not ({queries.HELD_OUT})"))
    named = docs.select(*COLUMNS).withColumn("text", F.coalesce("text", F.lit("")))
    return language_id.with_language(named, model).where(f"lang <> 'und' and score >= {SURE}").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that consist of nothing else go."""
    queries.prepare(spark)
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("n_dropped = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    queries.prepare(spark)
    late = superminhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(late, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontamination.find_leaks(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed, with the digests of the ids and of what they decode to."""
    queries.prepare(spark)
    return byte_bpe.encode_documents(docs, queries.RANKS, queries.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None  # segmentation sums, MinHash components and merges by rank are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.store(stage(spark, docs, sf_dir), name)
    return docs
