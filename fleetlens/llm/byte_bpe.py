"""Byte-level BPE with a rank queue: encoding and decoding of whole texts."""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED = 200_000  # pre-tokens whose ids a worker keeps; those used since as many new ones came are kept longer
BYTES = 1 << 20  # of texts encoded at a time, about: what a worker holds doesn't grow with the rows of a batch
BITS = 6
LONG = 1 << BITS  # longer pre-tokens, in bytes, aren't kept


class RankQueue:
    """Positions by merge rank, and a bitmap of the ranks that have any.

    ``top`` has a bit for each 256 ranks and ``rows`` a bit for each rank, so that
    finding the lowest rank is two find-first-set operations whatever the number of
    entries. A bucket is a heap of positions, for the leftmost of equal pairs comes
    first. Entries aren't removed when a pair changes; whoever pops one checks it.
    """

    __slots__ = ("top", "rows", "buckets")

    def __init__(self) -> None:
        self.top, self.rows, self.buckets = 0, {}, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            row = rank >> 8
            self.rows[row] = self.rows.get(row, 0) | 1 << (rank & 255)
            self.top |= 1 << row
        else:
            heapq.heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        row = (self.top & -self.top).bit_length() - 1
        bits = self.rows[row]
        low = (bits & -bits).bit_length() - 1
        rank = row << 8 | low
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.rows[row] = bits = bits & ~(1 << low)
            if not bits:
                self.top &= ~(1 << row)
        return rank, position


class ByteBPE:
    """A rank file's encoder. ``pairs`` holds the merged id of two neighbouring ids, if any."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = dict(map(reversed, self.ranks.items()))
        self.split = regex.compile(pattern).findall
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.width = max(self.bytes) + 1
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = rank
        self.start = [self.pairs.get(a * self.width + b, -1) for a in self.single for b in self.single]  # rank by two bytes
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table = pa.array([self.bytes.get(k) for k in range(self.width)], pa.large_binary())

    def _merge_short(self, piece: bytes) -> list[int]:
        """As ``merge``, with one heap of rank and position, for a piece has a handful of pairs."""
        pair, width, start = self.pairs.get, self.width, self.start
        n = len(piece)
        ids = [self.single[b] for b in piece]  # -1 where a merge has taken the position
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [start[a << 8 | b] for a, b in zip(piece, piece[1:])]
        queue = [rank << BITS | i for i, rank in enumerate(rank_at) if rank >= 0]
        rank_at.append(-1)
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            lowest = pop(queue)
            rank, i = lowest >> BITS, lowest & (1 << BITS) - 1
            if rank_at[i] != rank:
                continue  # the pair has changed since
            gone = after[i]
            ids[i], ids[gone], rank_at[gone] = rank, -1, -1
            after[i], now = (right := after[gone]), -1
            if right < n:
                before[right] = i
                now = pair(rank * width + ids[right], -1)
                if now >= 0:
                    push(queue, now << BITS | i)
            rank_at[i], left = now, before[i]
            if left >= 0:
                now = rank_at[left] = pair(ids[left] * width + rank, -1)
                if now >= 0:
                    push(queue, now << BITS | left)
        return [k for k in ids if k >= 0]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank first, the leftmost of equal ones first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= LONG:
            return self._merge_short(piece)
        n, pair, width, queue = len(piece), self.pairs.get, self.width, RankQueue()
        push, pop = queue.push, queue.pop
        numbers = partial(array, "i")  # a tenth of the memory that lists take
        ids = numbers(map(self.single.__getitem__, piece))
        after, before = numbers(range(1, n + 1)), numbers(range(-1, n - 1))
        rank_at = numbers([-1]) * n  # rank of the pair that starts here, -1 if none
        for i in range(n - 1):
            rank = pair(ids[i] * width + ids[i + 1], -1)
            if rank >= 0:
                rank_at[i] = rank
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if rank_at[i] != rank:
                continue  # the pair has changed since
            gone = after[i]
            ids[i], after[i], rank_at[gone] = rank, after[gone], -1
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0:
                    right = after[at]
                    now = pair(ids[at] * width + ids[right], -1) if right < n else -1
                    if now != rank_at[at]:
                        rank_at[at] = now
                        if now >= 0:
                            push(now, at)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _packed(self, piece: str) -> bytes:
        packed = self.kept.get(piece) or self.older.get(piece)
        if not packed:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = self.merge(raw)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) > LONG:
                return packed
        if len(self.kept) >= CACHED:
            self.kept, self.older = {}, self.kept
        self.kept[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        kept = self.kept.get
        return b"".join([kept(piece) or self._packed(piece) for piece in self.split(text or "")])

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids, gathered from the vocabulary."""
        if not packed:
            return b""
        found = self.table.take(pa.Array.from_buffers(pa.uint32(), len(packed) // 4, [None, pa.py_buffer(packed)]))
        if found.null_count:
            raise KeyError("an id that the vocabulary doesn't have")
        return b"".join(found.buffers()[2:])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder per rank file and worker."""
    return ByteBPE(path, pattern)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BYTES of text; a text is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype("int64")
    group = (sizes.cumsum() - sizes) // BYTES
    at = [0, *(k for k in range(1, len(group)) if group[k] != group[k - 1]), len(group)]
    for start, end in zip(at, at[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def _encode(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for part in _parts(batch):
                counts, digests, decoded, ids = [], [], [], []
                for text in part.column(1):
                    packed = bpe.encode(text.as_py())
                    counts.append(len(packed) // 4)
                    digests.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
                    ids.append(packed)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) for every row of ``docs``.

    ``ids`` are packed as little-endian unsigned 32-bit integers; ``decoded_sha256``
    is the digest of what decoding them gives. A match of ``pattern`` is a pre-token;
    one that is in the vocabulary is a token, others are merged by rank. No special
    tokens. A null text is encoded as the empty text; a null id is carried.
    The work of a pre-token of n bytes grows as n log n. Other columns are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return rows.mapInArrow(_encode(path, pattern, with_ids), schema)
