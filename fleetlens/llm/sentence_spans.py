"""Substring dedup by sliding sentence spans: runs are cut and hashed inside tasks, then joined over all documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.workspace import Workspace

MIN_SENTENCES, MIN_WORDS = 2, 20
CHUNK = 100_000  # runs after which a task hands them on
# Up to the white space behind a closing mark, or up to line ends. The matches add up to the text.
SENTENCE = r"(?s).+?(?:[.!?]\s+|\n\s*|\z)"
PIECE = re.compile(SENTENCE.replace(r"\z", r"\Z"), re.ASCII)  # the same in Python's notation


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def _once(value: Column) -> Column:
    """A column that later expressions read instead of working it out again for every element."""
    return F.explode(F.array(value))


def _keys(text: str | None) -> Iterator[tuple[int, int, bytes]]:
    """(pos, n, key): the shortest run from each sentence and the shortest up to each, n sentences and their 128-bit hash.

    Together they cover what any longer run covers, as its own shortest runs lie within it.
    """
    whole = [s.strip(" \t\r\n") for s in PIECE.findall((text or "").lower())]
    words = [s.count(" ") + 1 for s in whole]
    run = lambda i, j: (i, j - i, xxhash.xxh3_128_digest("\n".join(whole[i:j]).encode("utf-8", "surrogatepass")))
    end = held = last = 0
    for i in range(len(whole)):
        while end < len(whole) and (held < MIN_WORDS or end - i < MIN_SENTENCES):
            held += words[end]
            end += 1
        if i:  # ends that the run from here reaches past: the shortest run up to them starts one sentence before
            enough = held >= MIN_WORDS and end - i >= MIN_SENTENCES
            for j in range(last + 1, end if enough else end + 1):
                yield run(i - 1, j)
        if held < MIN_WORDS or end - i < MIN_SENTENCES:
            break  # later runs are shorter still
        yield run(i, end)
        held, last = held - words[i], end


def _table(ids: list[int], counts: list[int], runs: list[tuple]) -> pa.RecordBatch:
    at, sizes, keys = zip(*runs)
    halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    columns = [pa.array(np.repeat(ids, counts)), pa.array(at, pa.int32()), pa.array(sizes, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "pos", "n", "k1", "k2"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, runs = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            before = len(runs)
            runs.extend(_keys(text.as_py()))
            ids.append(doc_id)
            counts.append(len(runs) - before)
            if len(runs) >= CHUNK:
                yield _table(ids, counts, runs)
                ids, counts, runs = [], [], []
        if runs:
            yield _table(ids, counts, runs)


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """(doc_id, drop) for documents that lose sentences; drop holds sentence numbers, from 0.

    A run is 2 sentences and 20 words or more, one after the other; the shortest from each sentence
    and the shortest up to each are compared, which drops what all runs would drop. Equal runs (lower case, outer white space aside) are joined over all
    documents by a 128-bit hash; the first by (doc_id, sentence number) stays, and
    every sentence that another one covers is dropped, whatever else covers it.
    Shorter texts have no run. Rows that share an id are one document. A null id or text takes no part.
    """
    ws = ws or Workspace(docs.sparkSession, "spans")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = rows.mapInArrow(_runs, "doc_id long, pos int, n int, k1 long, k2 long")
    runs = ws.store(runs, "runs")
    known = runs.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("times"))
    known = ws.store(known.where("times > 1").select("k1", "k2", "first"), "known")
    late = runs.join(known, ["k1", "k2"]).where(F.struct("doc_id", "pos") > F.col("first"))
    late = late.select("doc_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("at")).distinct()
    return ws.store(late.groupBy("doc_id").agg(F.sort_array(F.collect_list("at")).alias("drop")), "drop")


def drop_repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the sentences named by ``repeated_sentences``, and n_sentences, n_dropped.

    The other sentences keep their marks and white space. Other columns stay (n_sentences
    and n_dropped are replaced). A null or empty text stays as it is, with 0 sentences.
    """
    ws = Workspace(docs.sparkSession, "spans")
    drop = repeated_sentences(docs, id_col, text_col, ws).select(F.col("doc_id").alias("__id"), F.col("drop").alias("__drop"))
    docs = docs.drop("n_sentences", "n_dropped")
    out = docs.join(drop, docs[id_col].cast("long") == drop["__id"], "left")
    out = out.withColumn("__s", _once(F.coalesce(sentences(F.col(text_col)), F.array().cast("array<string>"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__s") - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__s", i)), ""))
    counts = {"n_sentences": F.size("__s").cast("long"), "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long")}
    return out.withColumns(counts | {text_col: text}).drop("__id", "__drop", "__s")
