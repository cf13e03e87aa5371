"""Short pre-tokens: merged as by a plain loop, and not much slower than one."""

import random
import time

from fleetlens.llm import byte_bpe, queries


def plain(bpe: byte_bpe.ByteBPE, piece: bytes) -> list[int]:
    """The lowest rank of all pairs, found by looking at each."""
    none, ids = bpe.width, [bpe.single[b] for b in piece]
    ranks = [bpe.pairs.get(a * bpe.width + b, none) for a, b in zip(ids, ids[1:])]
    while ranks and (low := min(ranks)) < none:
        i = ranks.index(low)
        ids[i] = low
        del ids[i + 1], ranks[i]
        if i:
            ranks[i - 1] = bpe.pairs.get(ids[i - 1] * bpe.width + low, none)
        if i < len(ranks):
            ranks[i] = bpe.pairs.get(low * bpe.width + ids[i + 1], none)
    return ids


def seconds(merge, pieces: list[bytes]) -> float:
    start = time.process_time()
    for piece in pieces:
        merge(piece)
    return time.process_time() - start


def test_short_pieces():
    bpe, draw = byte_bpe.encoder(queries.RANKS, queries.PATTERN), random.Random(7)
    parts = ["th", "e", "ing", "er", "tion", "an", "on", "re", "é", "中文", "ss", "\x00", "aaa", "0"]
    words = [("".join(draw.choices(parts, k=draw.randint(1, 9)))).encode()[: byte_bpe.LONG] for _ in range(4000)]
    words += [b"a" * n for n in range(1, byte_bpe.LONG + 1)] + [bytes(draw.choices(range(256), k=byte_bpe.LONG)) for _ in range(200)]
    assert [bpe._merge_short(w) for w in words] == [plain(bpe, w) for w in words]


def test_short_pieces_take_little_time():
    """The bitmaps that came before took over three times the plain loop's time."""
    bpe, draw = byte_bpe.encoder(queries.RANKS, queries.PATTERN), random.Random(8)
    words = [(" " + "".join(draw.choices(["th", "e", "ing", "er", "tion", "an", "on", "re"], k=4))).encode() for _ in range(5000)]
    assert min(seconds(bpe._merge_short, words) / seconds(lambda w: plain(bpe, w), words) for _ in range(4)) < 2.2
