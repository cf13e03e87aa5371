"""Periodic runs of words: maximal pairs from the LCP-interval tree of each text."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text_hash import WORDS, shingles

LEAST, TIMES = 6, 4  # a run has at least so many words, and so many times its period
HELD = 400_000  # words whose suffixes are sorted together; a longer text is sorted alone
RUNS = "array<struct<start:long,length:long,period:long>>"


def _ranks(first: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling: ranks by the first 1, 2, 4, ... words until no two positions that matter are equal.

    ``first`` ranks the positions by one word. Only groups of equal rank are sorted again.
    A rank is the number of positions before the group, so ranks are equal exactly where the prefixes are.
    """
    n, out = len(first), [first]
    size = 1
    active = np.arange(n)
    while True:
        rank = out[-1]
        counts = np.bincount(rank, minlength=n)
        active = active[counts[rank[active]] > 1]
        if not len(active):
            return out
        ahead = np.minimum(active + size, n - 1)  # the last position ends a text, and its rank is its own
        key = rank[active] * np.int64(n) + rank[ahead]
        order = np.argsort(key, kind="stable")
        group, key = rank[active][order], key[order]
        at = np.arange(len(order))
        head = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(head, at, 0))
        inner = np.maximum.accumulate(np.where(new, at, 0))
        fresh = rank.copy()
        fresh[active[order]] = group + inner - start
        out.append(fresh)
        size *= 2


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b."""
    out = np.zeros(len(a), np.int64)
    last = len(ranks[0]) - 1
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + out, b + out
        same = (x <= last) & (y <= last)
        same[same] = ranks[k][x[same]] == ranks[k][y[same]]
        out[same] += 1 << k
    return out


def _walk(suffix: list, lcp: list, left: np.ndarray, floor: int, found: list) -> None:
    """Bottom-up over the LCP-interval tree of one group of suffixes; appends (start, length, period).

    A node keeps its positions in order; a position's class is the word to its left. When a node is
    closed, the positions of its smaller children go into the list of its largest. Two positions of
    different children and different classes are a maximal pair, and the pair of a run's
    smallest period has no other position of the node between its ends, so only neighbours are looked at.
    """
    stack: list = []

    def close(depth: int, children: list) -> list:
        children.sort(key=len)
        base = children.pop()
        owner = {p: c for c, child in enumerate(children) for p in child}
        if len(owner) * 8 < len(base):
            for p in owner:
                insort(base, p)
        else:
            base = sorted([*base, *owner])
        for p, mine in owner.items():
            k = bisect_left(base, p)
            for a, b in ((k - 1, k), (k, k + 1)):
                if a < 0 or b == len(base):
                    continue
                i, j = base[a], base[b]
                other = owner.get(i if b == k else j, -1)
                if other == mine or (other >= 0 and b == k):  # each pair once
                    continue
                period = j - i
                if depth >= (TIMES - 1) * period and depth + period >= LEAST and left[i] != left[j]:
                    found.append((i, depth + period, period))
        return base

    current = [suffix[0]]
    for p, depth in zip([*suffix[1:], None], [*lcp[1:], 0]):
        while stack and stack[-1][0] > depth:
            level, children = stack.pop()
            children.append(current)
            current = close(level, children)
        if depth >= floor:
            if stack and stack[-1][0] == depth:
                stack[-1][1].append(current)
            else:
                stack.append((depth, [current]))
        current = [p]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start, then period, of several texts given as word hashes.

    A run has 3 periods and 5 words at least in common with itself one period on, so only suffixes that
    share 5 words with another suffix of their text can be part of a maximal pair; and a group of such suffixes
    matters only where two of them are as near as a third of its longest common prefix.
    """
    out: list[list] = [[] for _ in texts]
    floor = LEAST - 1
    twice = []
    for k, words in enumerate(texts):
        if len(words) >= LEAST:
            grams = np.sort(shingles(words, floor))
            if (grams[1:] == grams[:-1]).any():
                twice.append(k)
    if not twice:
        return out
    sizes = np.array([len(texts[k]) + 1 for k in twice])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = int(ends[-1])
    text = np.repeat(np.arange(len(twice)), sizes)
    words = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    words[inside] = np.concatenate([texts[k] for k in twice])
    number = np.unique(words[inside], return_inverse=True)[1]
    key = np.empty(n, np.int64)  # a word of one text differs from that of another; what ends a text is a word of its own
    key[inside] = text[inside] * np.int64(n + 1) + number + 1
    key[~inside] = np.arange(len(twice)) * np.int64(n + 1)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.empty(n, np.int64)
    first[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks = _ranks(first)
    suffix = np.empty(n, np.int64)
    suffix[ranks[-1]] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    lcp[1:n] = _common(ranks, suffix[:-1], suffix[1:])
    left = np.empty(n, np.int64)
    left[1:], left[0] = key[:-1], -1
    left[starts] = -1 - np.arange(len(twice))  # nothing is to the left of a text's first word
    deep = lcp[:n] >= floor
    heads = np.flatnonzero(~deep & np.concatenate([deep[1:], [False]]))  # first suffix of each group
    if not len(heads):
        return out
    member = deep.copy()
    member[heads] = True
    rows = np.flatnonzero(member)
    group = np.cumsum(~deep[rows]) - 1
    begin = np.flatnonzero(~deep[rows])
    longest = np.maximum.reduceat(np.where(deep[rows], lcp[rows], 0), begin)
    by_place = np.lexsort((suffix[rows], group))
    gap = np.diff(suffix[rows][by_place], prepend=0)
    gap[begin] = n
    nearest = np.minimum.reduceat(gap, begin)
    until = np.append(begin[1:], len(rows))
    found: list = []
    for g in np.flatnonzero(longest >= (TIMES - 1) * nearest):
        at = rows[begin[g] : until[g]]
        _walk(suffix[at].tolist(), lcp[at].tolist(), left, floor, found)
    for start, length, period in sorted(found, key=lambda r: (r[0], r[2])):
        k = int(text[start])
        out[twice[k]].append((start - int(starts[k]), length, period))
    return out


def _dropped(n: int, runs: list) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
        hashes, runs = [], []
        held = 0
        for words in texts:
            if hashes and held + len(words) > HELD:
                runs += runs_of(hashes)
                hashes, held = [], 0
            hashes.append(WORDS.of(words))
            held += len(words)
        runs += runs_of(hashes)
        kept = []
        for words, spans in zip(texts, runs):
            if spans:
                words = [w for w, gone in zip(words, _dropped(len(words), spans).tolist()) if not gone]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        spans = [[{"start": s, "length": n, "period": q} for s, n, q in row] for row in runs]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``.

    Words are what white space of ASCII separates, numbered from 0. A run is a maximal stretch of
    words whose smallest period repeats at least 4 times in it and that has at least 6 words; ``runs``
    lists (start, length, period) by start, then period. ``collapsed`` joins the words by a
    blank, without those that lie in a run behind its first period.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Repeated rows and null
    ids keep a row each; other columns are neither read nor returned. Texts are independent, so
    nothing is shuffled; a text is sorted whole, however long it is.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def longest_first(runs: Column) -> Column:
    """The run of the greatest length/period, compared exactly; ties: smallest start, then period. Null if there is none."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    same = lambda a, b: a["length"] * b["period"] == b["length"] * a["period"]
    before = lambda a, b: more(a, b) | same(a, b) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["period"] < b["period"]))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(before(r, best), r).otherwise(best))


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with periodic tails planted in a tenth of the texts, chosen and cut by the crc32 of the id.

    With h the crc32 of the decimal id and g = h div 10, a text of n > 0 words with h % 10 = 0 gets, from word
    a = g % n on, its words a to a + p - 1 over and over, p = 1 + (n - a) div (3 + g % 8). Texts without
    words and rows with a null id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.split(F.btrim(F.regexp_replace(text_col, "[\\x20\\x09-\\x0D]+", " "), F.lit(" ")), " ", -1)

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        again = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.array_join(again, " ")

    chosen = (h % 10 == 0) & F.col(text_col).rlike("[^\\x20\\x09-\\x0D]")
    planted = F.get(F.transform(F.array(words), tail), F.lit(0))
    return docs.withColumn(text_col, F.when(chosen, planted).otherwise(F.col(text_col)))
