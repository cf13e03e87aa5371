"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.linking import link, roots
from fleetlens.llm.text_hash import GOLDEN, WORDS, ascii_words, mix, shingles, stride
from fleetlens.llm.workspace import Workspace

SLOTS, ROWS = 128, 4  # 32 bands; a pair at similarity 0.8 shares none with probability 5e-8
CHUNK = 200_000  # elements whose permutations are held at a time


def signatures(elements: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of several sets laid end to end; one row of ``slots`` values each.

    Element by element the method draws a random permutation, one position a
    level, and offers level + random fraction to the slot at that position. All
    elements of all sets take a level together here. A set is left out of the
    next level as soon as its largest value lies below that level (the early
    stop), so a set much larger than ``slots`` takes one or two levels.
    A value keeps the level in its upper 32 bits and the fraction in the lower.
    """
    out = np.full((len(sizes), slots), np.iinfo(np.uint64).max, np.uint64)
    flat, owner, order = out.reshape(-1), np.repeat(np.arange(len(sizes)), sizes), None
    for level in range(slots):
        draw = mix(elements + stride(level + 1))
        at = level + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = at
        else:
            row = np.arange(len(elements))
            slot = order[row, at].astype(np.int64)
            order[row, at] = order[:, level]
        np.minimum.at(flat, owner * slots + slot, np.uint64(level << 32) | draw >> np.uint64(32))
        busy = (out.max(axis=1) >> np.uint64(32)) > level
        stay = busy[owner]
        if not stay.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint16), (int(stay.sum()), 1))
            order[np.arange(len(order)), slot[stay]] = 0
        elif not stay.all():
            order = order[stay]
        elements, owner = elements[stay], owner[stay]
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of ``rows`` slots; the band's number is part of the key."""
    parts = signature.reshape(len(signature), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        key = mix(key * GOLDEN + parts[:, :, k])
    return key


def _sets(texts: list, words: int) -> list[np.ndarray]:
    return [np.unique(shingles(WORDS.of(ascii_words(t)), words)) for t in texts]


def _chunks(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, s in enumerate(sets):
        if held and held + len(s) > CHUNK:
            yield start, k
            start, held = k, 0
        held += len(s)
    if start < len(sets):
        yield start, len(sets)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(1).to_pylist(), words)
            keys: list = []
            for i, j in _chunks(sets):
                sizes = np.array([len(s) for s in sets[i:j]])
                rows = bands(signatures(np.concatenate(sets[i:j]), sizes)).view(np.int64)
                keys.extend(row if n else None for row, n in zip(rows, sizes))
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def _compare(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # sets of the batch
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            held.clear()
            common, both = [], []
            for k in range(len(batch)):
                x, y = (held[i] if (i := int(ids[k])) in held else held.setdefault(i, _sets([batch.column(c)[k].as_py()], words)[0]) for ids, c in ((a, 2), (b, 3)))
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
                both.append(len(x) + len(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(both, pa.int64())], ["a", "b", "common", "both"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 columns, one for each element that two sets hold, some thousand at a time."""
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = times[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _dense(words: int, num: int, den: int):
    """Links between two blocks of a bucket, as a forest."""

    def forest(ids: list, block: np.ndarray, i: int, j: int, texts: list) -> list[tuple]:
        sets = _sets(texts, words)
        common, n = _common(sets), np.array([len(s) for s in sets])
        linked = (den + num) * common >= num * (n[:, None] + n[None, :])
        linked &= (block[:, None] == i) & (block[None, :] == j) | (block[:, None] == j) & (block[None, :] == i)
        a, b = np.nonzero(np.triu(linked, 1))
        root = roots(len(ids), a, b)
        return [(ids[k], ids[r]) for k, r in enumerate(root) if k != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, block, texts, out = None, [], [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for at, own, doc_id, text in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                if at != key and ids:
                    out += forest(ids, np.array(block), key[1], key[2], texts)
                    ids, block, texts = [], [], []
                key = at
                ids.append(doc_id)
                block.append(own)
                texts.append(text.as_py())
            if out:
                yield _edges(out)
                out = []
        if ids:
            yield _edges(forest(ids, np.array(block), key[1], key[2], texts))

    return run


def _edges(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if the sets of their ``words``-word shingles have a
    Jaccard similarity of num/den or more; the smallest id of a component is kept.
    Equal sets are one node from the start, so thousands of copies are compared
    once. Candidates share one of 32 bands of 4 SuperMinHash slots; all of them
    are verified on the full sets (see ``linking.link``).

    A null, empty or blank text has no shingles and links with nothing; a text of
    fewer words is one shingle. Rows with one id are one document (linked by any
    of their texts) and keep a row each. A null id takes no part: its component
    is null and it is kept. Other columns are neither read nor returned.
    """
    ws = Workspace(docs.sparkSession, "near-duplicates")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = ws.store(rows.mapInArrow(_sketch(words), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketch")
    classes = sketch.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "bands")).alias("first"))
    classes = ws.store(classes.select("set_key", F.col("first.doc_id").alias("id"), F.col("first.bands").alias("bands")), "classes")

    def fetch(ids: DataFrame) -> DataFrame:
        return rows.join(ids, rows["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(_compare(words), "a long, b long, common long, both long")

    def dense(blocks: DataFrame) -> DataFrame:
        return blocks.mapInArrow(_dense(words, num, den), "a long, b long")

    linked = link(classes.select(F.explode("bands").alias("key"), "id"), fetch, verify, ws, num, den, 512, dense)
    node = classes.select("set_key", "id").join(linked, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    # rows without shingles get keys of their own, lest all of them meet in one task
    key = F.coalesce("set_key", F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    out = sketch.select("doc_id", "n_shingles", key.alias("set_key")).join(node, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
