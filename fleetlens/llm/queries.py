"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import best_position, byte_bpe, decontamination, language_id, lattice, licenses, line_dedup, page_template, sentence_spans, superminhash, token_counts, warc, word_runs
from fleetlens.session import tune

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SEPARATOR = 50256  # free in the vocabulary
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def prepare(spark: SparkSession) -> SparkSession:
    """Batches of a thousand rows for Python: a long text is a few megabytes, and a worker holds a batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_embeddings(table(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, RANKS, F.expr(f"not ({HELD_OUT})"))
    return language_id.predict(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN, with_ids=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    late = line_dedup.duplicate_lines(docs)
    dropped = F.coalesce("drop", F.array().cast("array<int>"))
    return docs.select("doc_id").join(late, "doc_id", "left").select("doc_id", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped_lines"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_spans.drop_repeated_sentences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_dropped", "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, sf_dir, "documents"), RANKS, PATTERN, SEPARATOR).select("doc_id", "n_tokens")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_page_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_template.extract_text(table(spark, sf_dir, "pages"))


def op12_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = word_runs.find_runs(word_runs.repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = word_runs.longest_first(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_lattice, op3_licenses, op4_language_id, op5_superminhash, op6_byte_bpe, op7_line_dedup, op8_sentence_spans, op9_token_counts, op10_decontamination, op11_page_template, op12_best_position, op13_word_runs)
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

ORACLE: dict[str, str] = {
    "op12_best_position": f"""
with docs as (select row_number() over () as row_no, doc_id, {TERMS} as terms from documents),
sizes as (select row_no, doc_id, len(terms)::bigint as n from docs),
facts as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes where n > 0),
items as (select distinct item_id, unnest({TERMS}) as term from benchmark where item_id is not null),
held as (
    select row_no, term, count(*)::bigint as tf from (select row_no, unnest(terms) as term from docs) where term in (select term from items) group by all
),
weights as (
    select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, facts group by term
),
scored as (
    select item_id, doc_id, row_no, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::bigint as score
    from items join held using (term) join weights using (term) join sizes using (row_no), facts
    where doc_id is not null
    group by all
),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
""",
}
