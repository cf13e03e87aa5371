"""Ranked lexical search by the Best Position Algorithm over impact lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.workspace import Workspace

ITEM_TERMS = 200_000  # terms of the query items that are searched for in one pass over the documents
POSTINGS = 1_000_000  # entries of the impact lists that a task holds at a time
FIRST = 64  # positions read of each list at first; each round reads twice as many
# what is no letter or digit of ASCII ends a term; bytes from 128 on belong to one
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(terms_of(t))) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[w.decode("utf-8", "replace") for w in row] for row in terms], kind)], ["item_id", "terms"])


def _postings(number: dict[bytes, int]):
    """Per document: its length, and which of the numbered terms it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        kind = pa.list_(pa.int32())
        for batch in batches:
            sizes, terms, times, offsets = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                known = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                held, count = np.unique(known[known >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(held)
                times.append(count.astype(np.int32))
                offsets.append(offsets[-1] + len(held))
            lists = (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(x), pa.int32())) for x in (terms, times)) if terms else (pa.array([], kind),) * 2
            place = [xxhash.xxh64_intdigest(f"{task} {seen + k}") >> 1 for k in range(len(batch))]
            seen += len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(place, pa.int64()), *lists], ["doc_id", "n", "place", "terms", "times"])

    return run


class _Lists:
    """Impact lists of some documents: each term's documents by falling impact, and direct access to any of them."""

    def __init__(self, n_docs: int, owner: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        self.n_docs = n_docs
        order = np.lexsort((owner, -impact, term))
        self.docs, self.impacts = owner[order], impact[order]
        held, start = np.unique(term[order], return_index=True)
        self.span = dict(zip(held.tolist(), zip(start.tolist(), np.append(start[1:], len(term)).tolist())))
        self._direct: dict = {}

    def direct(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Impact and position of the documents in a term's list; 0 and -1 where they aren't in it."""
        a, b = self.span[term]
        long = (b - a) * 4 > self.n_docs
        if term not in self._direct:
            if long:
                impact, place = np.zeros(self.n_docs, np.int64), np.full(self.n_docs, -1, np.int32)
                impact[self.docs[a:b]], place[self.docs[a:b]] = self.impacts[a:b], np.arange(b - a)
                self._direct[term] = impact, place
            else:
                order = np.argsort(self.docs[a:b])
                self._direct[term] = self.docs[a:b][order], order
        if long:
            impact, place = self._direct[term]
            return impact[docs], place[docs]
        known, order = self._direct[term]
        at = np.minimum(np.searchsorted(known, docs), b - a - 1)
        found = known[at] == docs
        place = np.where(found, order[at], -1)
        return np.where(found, self.impacts[a:b][place], 0), place


def best_positions(lists: _Lists, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores among which are the ``k`` best, with all that equal the last of these.

    The lists are read in parallel by falling impact, some positions a round. A document met
    for the first time is looked up in all the lists, which also marks its positions there. A
    list's best position is the last of the unbroken row of marked ones from its top. No document that
    wasn't met can score more than the impacts at the best positions together (an
    ended list adds nothing), so reading stops as soon as that sum is strictly below the kth score.
    """
    terms = [t for t in terms if t in lists.span]
    bounds = [lists.span[t] for t in terms]
    marked = [np.zeros(b - a + 1, bool) for a, b in bounds]  # one more, never marked
    best = [0] * len(terms)
    met = np.zeros(lists.n_docs, bool)
    docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    depth, step, longest = 0, FIRST, max((b - a for a, b in bounds), default=0)
    while depth < longest:
        read = [lists.docs[a + depth : min(a + depth + step, b)] for a, b in bounds if a + depth < b]
        fresh = np.unique(np.concatenate(read))
        fresh = fresh[~met[fresh]]
        met[fresh] = True
        score = np.zeros(len(fresh), np.int64)
        limit = 0
        for j, (t, (a, b)) in enumerate(zip(terms, bounds)):
            if len(fresh):
                impact, place = lists.direct(t, fresh)
                score += impact
                marked[j][place[place >= 0]] = True
            best[j] += int(np.argmin(marked[j][best[j] :]))
            if best[j] < b - a:
                limit += int(lists.impacts[a + best[j] - 1])
        docs.append(fresh)
        scores.append(score)
        depth, step = depth + step, 2 * step
        if sum(map(len, scores)) >= k:
            every = np.concatenate(scores)
            docs, scores = [np.concatenate(docs)], [every]
            if limit < np.partition(every, len(every) - k)[len(every) - k]:
                break
    return np.concatenate(docs), np.concatenate(scores)


def _search(items: list[tuple[int, list[int]]], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Best documents of a shard for every item."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        owner = np.repeat(np.arange(len(ids)), table["terms"].combine_chunks().value_lengths().to_numpy())
        term, times = (table[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
        length = 50 + 50 * table["n"].to_numpy() * n_docs // n_terms
        impact = weight[term] * (1_000_000_000 * times // (1000 * times + 20 * length[owner]))
        use = impact > 0
        lists = _Lists(len(ids), owner[use], term[use], impact[use])
        out: list[tuple] = []
        for item, terms in items:
            docs, scores = best_positions(lists, terms, k)
            if len(docs) > k:
                enough = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                docs, scores = docs[enough], scores[enough]
            top = np.lexsort((ids[docs], -scores))[:k]
            out += [(item, int(ids[docs[x]]), int(scores[x])) for x in top if scores[x] > 0]
        return pa.table({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("item_id", "doc_id", "score"))})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item; equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. N documents have a term,
    L terms in all; a term in df documents weighs w = floor(1000 ln((2N + 2) / (2df + 1))). A document of n terms that
    holds it tf times scores w * (10^9 tf div (1000 tf + 20 m)) for it, m = 50 + 50nN div L; an item's terms count once.

    Documents are dealt out in shards of about a million list entries; each searches its own impact lists
    for every item and returns its ``k`` best, from which the best of all are taken. Items go in
    blocks of about 200,000 terms, which are what tasks get whole; each block reads all documents once.

    Every row of ``docs`` is a document, also where ids repeat (they then rank by themselves); a
    null or empty text has no term. Rows with a null doc_id count in N, L and df but are not ranked. Items
    that share an id are one with the terms of all; a null item_id or an item without terms has no rows.
    Other columns are neither read nor returned. No documents or no items give an empty table.
    """
    ws = Workspace(docs.sparkSession, "search")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    asked = asked.mapInArrow(_split_items, "item_id long, terms array<string>").select("item_id", F.explode("terms").alias("term")).distinct()
    asked = ws.store(asked, "asked")
    blocks = -(-asked.count() // ITEM_TERMS)
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if not len(mine):
            continue
        number: dict[bytes, int] = {}
        wanted: dict[int, list[int]] = {}
        for item, term in zip(mine["item_id"].to_pylist(), mine["term"].to_pylist()):
            wanted.setdefault(item, []).append(number.setdefault(term.encode(), len(number)))
        posted = ws.store(rows.mapInArrow(_postings(number), "doc_id long, n long, place long, terms array<int>, times array<int>"), f"postings-{block}")
        n_docs, n_terms, entries = posted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        if not entries:
            continue
        held = posted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        weight = np.zeros(len(number), np.int64)
        for term, df in zip(held["term"].to_pylist(), held["count"].to_pylist()):
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        shards = -(-entries // POSTINGS)
        shard = F.pmod("place", F.lit(shards)).alias("shard")
        dealt = posted.where("doc_id is not null and size(terms) > 0").select(shard, "doc_id", "n", "terms", "times")
        best = dealt.groupBy("shard").applyInArrow(_search(sorted(wanted.items()), weight, n_docs, n_terms, k), "item_id long, doc_id long, score long")
        best = ws.store(best, f"best-{block}")
        ws.drop(f"postings-{block}")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
