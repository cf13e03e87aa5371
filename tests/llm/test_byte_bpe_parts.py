"""The encoder's batches: what a worker holds is bounded by bytes of text, not by the rows that Spark hands it."""

import struct

import pyarrow as pa

from fleetlens.llm import byte_bpe, queries


def test_large_batches_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "BYTES", 5000, raising=False)
    texts = [None, "", "one two", "é" * 9000, "", None] + [f"word{k} and 中文 {k * k} more" for k in range(1000)] + [""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    run = byte_bpe._encode(queries.RANKS, queries.PATTERN, True)
    parts = list(run(iter([batch, batch.slice(0, 0), batch.slice(2, 3)])))
    assert len(parts) > 5
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(len(texts)), 2, 3, 4]
    bpe = byte_bpe.ByteBPE(queries.RANKS, queries.PATTERN)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == bpe.encode(text) and r["n_tokens"] == len(r["ids"]) // 4
        assert b"".join(bpe.bytes[i] for i in struct.unpack(f"<{r['n_tokens']}I", r["ids"])) == text.encode()


def test_few_pre_tokens_are_kept():
    """Two generations of a worker's cache; with a million each, they and the batch took over 600 MB."""
    assert byte_bpe.CACHED <= 200_000
