"""Token counts from flat token files: a vectorised scan for separators, stitched over blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm import files
from fleetlens.llm.byte_bpe import encoder
from fleetlens.llm.workspace import Workspace

FILE_TOKENS = 16 << 20  # tokens after which a task starts another file
BLOCK_TOKENS = 1 << 20
DTYPE = np.dtype("<u2")


def _write(folder: str, path: str, pattern: str, separator: int):
    end = np.array([separator], DTYPE).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        out, name, tokens, ids = None, "", 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    name, out = files.create(folder, ".tokens")
                    tokens, ids = 0, []
                packed = np.frombuffer(bpe.encode(text.as_py()), "<u4").astype(DTYPE)
                out.write(packed.tobytes() + end)
                tokens += len(packed) + 1
                ids.append(doc_id)
                if tokens >= FILE_TOKENS:
                    out.close()
                    yield _listed(name, tokens, ids)
                    out = None
        if out is not None:
            out.close()
            yield _listed(name, tokens, ids)

    return run


def _listed(name: str, tokens: int, ids: list) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([tokens] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(ids, pa.int64())], ["file", "tokens", "ordinal", "doc_id"])


def write_tokens(docs: DataFrame, ws: Workspace, folder: str, path: str, pattern: str, separator: int) -> DataFrame:
    """Write documents to flat files of unsigned 16-bit ids, each followed by ``separator``; (file, tokens, ordinal, doc_id) of each.

    The files carry neither ids nor lengths of documents; the order of writing is what this table keeps.
    """
    if not encoder(path, pattern).width <= separator <= np.iinfo(DTYPE).max:
        raise ValueError("the separator must be a free id of 16 bits")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ws.store(rows.mapInArrow(_write(folder, path, pattern, separator), "file string, tokens long, ordinal long, doc_id long"), "written")


def _scan(folder: str, separator: int):
    """Each block's separators: their positions, the one before in the same block, and their number within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with files.open_file(folder, name) as source:
                    source.seek(first * DTYPE.itemsize)
                    ids = np.frombuffer(source.read(length * DTYPE.itemsize), DTYPE)
                at = np.flatnonzero(ids == separator) + first
                n = len(at)
                before = np.concatenate([[-1], at[:-1]]) if n else at
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.full(n, first)), pa.array(np.arange(n)), pa.array(at), pa.array(before, mask=before < 0)],
                    ["file", "first", "k", "at", "before"],
                )

    return run


def count_tokens(spark: SparkSession, sizes: DataFrame, ws: Workspace, folder: str, separator: int) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document that ends with a separator in the files of ``sizes`` (file, tokens).

    Files are read in blocks of a million ids, by any task; blocks are stitched by
    a prefix scan over one row per block: how many separators came before and where
    the last of them was. Ids behind the last separator of a file belong to no document.
    """
    last = F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)) - 1
    blocks = sizes.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("b"))
    blocks = blocks.select("file", (F.col("b") * BLOCK_TOKENS).alias("first"), F.least(F.lit(BLOCK_TOKENS), F.col("tokens") - F.col("b") * BLOCK_TOKENS).alias("length"))
    tasks = max(1, min(blocks.count(), 10_000))
    schema = "file string, first long, k long, at long, before long"
    found = ws.store(blocks.repartition(tasks).mapInArrow(_scan(folder, separator), schema), "separators")
    each = found.groupBy("file", "first").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    earlier = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select("file", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carried"))
    start = F.coalesce("before", "carried") + 1
    return found.join(carry, ["file", "first"]).select("file", (F.col("skipped") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"))


def document_tokens(docs: DataFrame, path: str, pattern: str, separator: int) -> DataFrame:
    """(doc_id, file, start, n_tokens) for every row of ``docs``: its tokens are written to flat files, then counted by scanning those.

    A null or empty text has no tokens. Rows that share an id, or have none, are
    documents of their own, told apart by file and start. Other columns are neither read nor returned.
    """
    ws = Workspace(docs.sparkSession, "tokens")
    folder = ws.path("files")
    written = write_tokens(docs, ws, folder, path, pattern, separator)
    sizes = written.select("file", "tokens").distinct()
    counted = count_tokens(docs.sparkSession, sizes, ws, folder, separator)
    return written.select("file", "ordinal", "doc_id").join(counted, ["file", "ordinal"]).select("doc_id", "file", "start", "n_tokens")
