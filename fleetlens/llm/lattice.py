"""Near-duplicate embeddings by E8 lattice hashing, cosine verification and union-find."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.linking import components, roots
from fleetlens.llm.text_hash import GOLDEN, mix
from fleetlens.llm.workspace import Workspace

TABLES, PROBES, SCALE = 6, 16, 0.8  # a pair at cosine 0.98 is missed with a probability of about 1e-7
BLOCK = 256
SEED = 20240229


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _shortest()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: round, and where the sum is odd round the worst entry the other way."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _code(points: np.ndarray, table: int) -> np.ndarray:
    """A hash of lattice points, which are multiples of one half."""
    twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
    key = np.full(points.shape[:-1], table, np.uint64)
    for k in range(8):
        key = mix(key * GOLDEN + twice[..., k])
    return key.view(np.int64)


@lru_cache(maxsize=None)
def _turn(table: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, width]).normal(size=(width, 8)) / SCALE


def cells(vectors: np.ndarray) -> np.ndarray:
    """(vector, table, 1 + PROBES): the cell of each unit vector and the neighbouring cells that lie nearest to it."""
    out = np.empty((len(vectors), TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        y = vectors @ _turn(t, vectors.shape[1])
        own = nearest_e8(y)
        near = np.argpartition(-((y - own) @ NEIGHBOURS.T), PROBES, axis=1)[:, :PROBES]
        out[:, t, 0] = _code(own, t)
        out[:, t, 1:] = _code(own[:, None, :] + NEIGHBOURS[near], t)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # lengths neither vanish nor overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _labelled(at: np.ndarray, label: np.ndarray, width: int) -> np.ndarray:
    """Cells of vectors of one label and width only."""
    apart = mix(label.astype(np.int64).view(np.uint64) * GOLDEN + np.uint64(width))
    return mix(at.view(np.uint64) ^ apart[:, None, None]).view(np.int64)


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    widths = batch.column(column).value_lengths().to_numpy()
    for w in np.unique(widths):
        yield batch.take(pa.array(np.flatnonzero(widths == w)))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, id, own): a vector's cell and probed cells of every table, apart by label and width."""
    for batch in batches:
        for part in _by_width(batch, 2):
            if len(part) and len(part.column(2)[0]):
                v = _units(_matrix(part.column(2)))
                at = _labelled(cells(v), part.column(1).to_numpy(), v.shape[1])
                ids = np.repeat(part.column(0).to_numpy(), TABLES * (1 + PROBES))
                own = np.tile(np.arange(1 + PROBES) == 0, len(part) * TABLES)
                yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1)), pa.array(ids), pa.array(own)], ["cell", "id", "own"])


def _meets(at: np.ndarray, table: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs share a cell of the table that is the own cell of one of them."""
    x, y = at[a, table], at[b, table]
    return (x[:, :1] == y).any(axis=1) | (y[:, :1] == x).any(axis=1)


def _first_meeting(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs known to meet: the cell of their first meeting, by table and then by value."""
    out, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for t in range(at.shape[1]):
        k = np.flatnonzero(open_)
        k = k[_meets(at, t, a[k], b[k])]
        x, y = at[a[k], t], at[b[k], t]
        there, back = (x[:, :1] == y).any(axis=1), (y[:, :1] == x).any(axis=1)
        big = np.iinfo(np.int64).max
        out[k] = np.minimum(np.where(there, x[:, 0], big), np.where(back, y[:, 0], big))
        open_[k] = False
    return out


def _verify(threshold: float):
    """Groups (cell, i, j) of rows that arrive together: the pairs between block i and block j, verified."""

    def group(cell: int, i: int, j: int, rows: dict[str, np.ndarray], v: np.ndarray) -> tuple | None:
        block, own = rows["block"], rows["own"]
        linked = v @ v.T >= threshold
        linked &= (block[:, None] == i) & (block[None, :] == j) if i != j else np.triu(np.ones(linked.shape, bool), 1)
        linked &= own[:, None] | own[None, :]
        a, b = np.nonzero(linked)
        if not len(a):
            return None
        ids, weight = rows["id"], rows["weight"]
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        root = np.sort(ids, kind="stable")[roots(len(ids), rank[a], rank[b])[rank]]
        # a pair meets in several cells and tables; it counts where it meets first
        at = _labelled(cells(v), rows["label"], v.shape[1])
        here = _first_meeting(at, a, b) == cell
        links = np.bincount(a[here], weight[b[here]], len(ids)) + np.bincount(b[here], weight[a[here]], len(ids))
        some = (links > 0) | (root != ids)
        return ids[some], links[some].astype(np.int64), root[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not len(held):
                continue
            keys = [held.column(c).to_numpy() for c in ("cell", "i", "j")]
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            ends = np.append(starts[1:], len(held))
            done = len(starts) - (batch is not None)  # the last group may go on in the next batch
            plain = {c: held.column(c).to_numpy() for c in ("id", "own", "block", "label", "weight")}
            vectors = held.column("embedding").combine_chunks()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            edge = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())])
            out = []
            for s, e in zip(starts[:done], ends[:done]):
                if e - s > 1 and plain["own"][s:e].any():
                    v = _units(flat[edge[s] : edge[e]].reshape(e - s, -1))
                    out.append(group(*(int(k[s]) for k in keys), {c: x[s:e] for c, x in plain.items()}, v))
            for found in filter(None, out):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "links", "root"])
            held = held.slice(starts[done]) if done < len(starts) else None

    return run


def near_embeddings(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label are linked if their cosine, in double precision, is at
    least ``threshold``; n_links counts the other vectors linked directly, and the
    smallest id of a component is kept. A vector that is null, empty, zero or holds
    null or non-finite components, and any with a null label, links with nothing;
    so do vectors of different length. Equal vectors of a label are one node from
    the start. Rows with one id are one vector (a repeated row doesn't count as a link);
    a null id takes no part: its component is null and it is kept.

    Each of 6 tables projects the unit vectors to 8 random dimensions and decodes
    them to points of the E8 lattice. Pairs are candidates if one's cell is the
    other's or one of the 16 neighbouring cells that lie nearest to it. Crowded
    cells are dealt out in pairs of blocks; a task returns counts and a spanning
    forest, never the pairs.
    """
    ws = Workspace(vectors.sparkSession, "lattice")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    good = rows.where("fine").select("vec_id", "label", "embedding").distinct()
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    classes = ws.store(classes, "classes")

    placed = ws.store(classes.select("id", "label", "embedding").mapInArrow(_place, "cell long, id long, own boolean"), "placed")
    crowd = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("own"), 1)).alias("owners")).where("n > 1 and owners > 0")
    crowd = crowd.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = placed.join(crowd, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    member = member.select("cell", "id", "own", "block", other)
    member = member.select("cell", "id", "own", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # an id may stand for several classes (rows with one id and different vectors); all of them are compared
    grouped = member.join(classes, "id").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    schema = "id long, links long, root long"
    found = ws.store(grouped.select("cell", "i", "j", "id", "own", "block", "label", "weight", "embedding").mapInArrow(_verify(threshold), schema), "found")
    ws.drop("placed")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), ws)
    node = classes.join(links, "id", "left").join(linked, "id", "left")
    node = node.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    # vectors that link with nothing get keys of their own, lest all of them meet in one task
    key = F.when(F.col("fine"), F.xxhash64("label", "embedding")).otherwise(F.xxhash64("vec_id"))
    node = node.withColumn("key", F.xxhash64("label", "embedding")).withColumnsRenamed({"label": "__label", "embedding": "__embedding"})
    rows = rows.withColumn("key", key)
    same = (rows["key"] == node["key"]) & rows["fine"] & (rows["label"] == node["__label"]) & (rows["embedding"] == node["__embedding"])
    out = rows.join(node, same, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
