"""Benchmark decontamination by template canonicalisation, a hash join of windows and a check of the slots."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text_hash import GOLDEN, mix, shingles
from fleetlens.llm.workspace import Workspace

WINDOW = 5  # tokens
LITERALS = 2  # tokens of a window that aren't placeholders, at least
NUM, DEN = 80, 100  # share of an item's tokens that matched windows cover
FILTER_BITS = 24  # the filter of benchmark windows has this many address bits, whatever the benchmark's size
KNOWN = 200_000  # tokens that a worker keeps
TOGETHER = 1 << 19  # characters of texts that are gone through together, about
NUMBER, UNIT, NAME = np.uint64(1), np.uint64(2), np.uint64(3)
EDGES = regex.compile(r"^[^\p{L}\p{N}%°€$£]+|[^\p{L}\p{N}%°€$£]+$")
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in "%$")  # what EDGES takes off an ASCII token
CLOSING = "\"'»”)]"
ENDS = (".", "!", "?", ":")
DIGITS = regex.compile(r"^[$€£]?[-+]?\p{N}")
# Signs and names of common units, taken as such behind a number.
UNITS = frozenset(
    "% ° €  $ £ mm cm m km in ft mi mg g kg t lb oz ml l gal s sec min h hr ms hz khz mhz ghz b kb mb gb tb v w kw kwh a n j kj cal kcal pa bar k c f mph kmh "
    "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres mile miles foot feet inch inches "
    "gram grams kilogram kilograms ton tons pound pounds ounce ounces liter liters litre litres gallon gallons dollar dollars euro euros cent cents percent degrees".split()
)


class Tokens(dict):
    """Numbers for raw tokens, and what a token is by itself: its hash and kinds (bits: 1 number, 2 unit, 4 capital, 8 ends a sentence)."""

    def __init__(self) -> None:
        super().__init__()
        self.word, self.kind = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint8)

    def __missing__(self, raw: str) -> int:
        at = len(self)
        if at == len(self.word):
            self.word, self.kind = np.concatenate([self.word] * 2), np.concatenate([self.kind] * 2)
        # the plain string methods do what the patterns do, where they can, in a fraction of the time
        if raw.isascii():
            bare = raw if raw.isalnum() else raw.strip(MARKS) or raw
        else:
            bare = EDGES.sub("", raw) or raw
        low = bare.lower()
        number = not bare[0].isalpha() and bool(DIGITS.match(bare))
        end = raw.rstrip(CLOSING).endswith(ENDS)
        self.kind[at] = number | 2 * (low in UNITS) | 4 * (not number and bare[:1].isupper()) | 8 * end
        self.word[at] = xxhash.xxh64_intdigest(low) | 8  # never the number of a placeholder
        self[raw] = at
        return at

    def canonical(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's tokens end and, per token of all texts, one text behind the other: its code (a placeholder's number, or the word's hash), the word's hash, whether it is a placeholder.

        Numbers are <number>; a unit behind a number is <unit>; a word with a
        capital that doesn't open the text or a sentence is <name>. Case and outer marks don't count.
        """
        if len(self) > KNOWN:
            self.clear()
        raw = [(t or "").split() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(raw)), np.int64, sizes.sum())
        word, kind = self.word[at], self.kind[at]
        first = np.zeros(len(at), bool)
        first[(ends - sizes)[sizes > 0]] = True
        number = (kind & 1) > 0
        unit = ((kind & 2) > 0) & np.roll(number, 1) & ~first
        opens = np.roll((kind & 8) > 0, 1) | first
        name = ((kind & 4) > 0) & ~opens & ~unit
        code = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, word)))
        return ends, code, word, number | unit | name


TOKENS = Tokens()


def _hashes(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """What ``shingles`` gives for the runs that start at the given positions."""
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mix(out * GOLDEN + codes[at + k])
    return out


def _windows(texts: list[str | None], table: np.ndarray | None) -> Iterator[tuple[int, int, int, list[int], int, list[int]]]:
    """(text's number, position, hash, what stands in the slots, the text's tokens, slot values held as words) of each window in up to three forms.

    The tokens that are placeholders in a form are: none (every window), numbers and units, names too
    (windows that have such tokens and enough others). Only windows that pass the filter ``table``, if there is one.
    The texts are gone through together: each numpy call has the tokens of all.
    """
    ends, code, word, slot = TOKENS.canonical(texts)
    sizes = np.diff(ends, prepend=0)
    left = np.repeat(ends, sizes) - np.arange(len(word))  # tokens from here to the text's end
    name = code == NAME
    amount = slot & ~name
    words_and_names = np.where(amount, code, word)
    none = np.zeros(len(word), bool)
    slots_to, names_to = (np.concatenate([[0], np.cumsum(marks)]) for marks in (slot, name))
    for size in range(1, WINDOW + 1):
        # a text of fewer tokens is one window
        at = np.flatnonzero(left >= WINDOW) if size == WINDOW else (ends - sizes)[sizes == size]
        slots, names = (total[at + size] - total[at] for total in (slots_to, names_to))
        least = min(LITERALS, size)
        some = at[(slots > 0) & (size - slots >= least)]
        few = at[(names > 0) & (slots > names) & (size - slots + names >= least)]
        for codes, where, open_ in ((word, at, none), (code, some, slot), (words_and_names, few, amount)):
            hashes = shingles(codes, WINDOW)[where] if codes is word and size == WINDOW and len(where) else _hashes(codes, where, size)
            if table is not None:
                keep = table[hashes & np.uint64((1 << FILTER_BITS) - 1)]
                hashes, where = hashes[keep], where[keep]
            text = np.searchsorted(ends, where, side="right")
            for k, p, h in zip(text.tolist(), where.tolist(), hashes.view(np.int64).tolist()):
                here, free = word[p : p + size].view(np.int64), open_[p : p + size]
                n = int(sizes[k])
                yield k, p - int(ends[k]) + n, h, here[free].tolist(), n, here[slot[p : p + size] & ~free].tolist()


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names)


def _together(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Keys and texts of a batch, some whole texts at a time."""
    keys, texts, held = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        keys.append(key)
        texts.append(text.as_py())
        held += len(texts[-1] or "")
        if held >= TOGETHER:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def _emit(names: list[str], wanted: np.ndarray | None):
    """Windows of the texts, with the hashes of what stands in their slots and of slot values that they hold as words; only those that pass the filter, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if wanted is None else np.unpackbits(wanted).view(bool)
        for batch in batches:
            out = []
            for keys, texts in _together(batch):
                out += [(keys[k], *rest) for k, *rest in _windows(texts, table)]
            yield _rows(names, out)

    return run


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "long", "long", "array<long>", "long", "array<long>")))


def best_match(doc_at: list[int], item_at: list[int], doc_values: list, item_values: list, tokens: int) -> tuple[int, int, int]:
    """(tokens covered, first position, slots filled anew) of the best stretch of two item lengths.

    Within a stretch each slot value of the item stands for one value of the
    document, the one that most windows give (ties: the smallest); windows that say
    otherwise don't count. Stretches start at every item length.
    """
    stretches = defaultdict(list)
    for k, p in enumerate(doc_at):
        stretches[p // tokens].append(k)
        stretches[p // tokens - 1].append(k)
    best = (0, 0, 0)
    for members in stretches.values():
        votes: dict[int, Counter] = defaultdict(Counter)
        for k in members:
            for a, b in set(zip(item_values[k], doc_values[k])):
                votes[a][b] += 1
        means = {a: min(v, key=lambda b: (-v[b], b)) for a, v in votes.items()}
        agreed = [k for k in members if all(means[a] == b for a, b in zip(item_values[k], doc_values[k]))]
        size = min(WINDOW, tokens)
        covered = {item_at[k] + j for k in agreed for j in range(size)}
        if agreed:
            used = {a for k in agreed for a in item_values[k]}
            best = max(best, (len(covered), -min(doc_at[k] for k in agreed), sum(means[a] != a for a in used)))
    return best[0], -best[1], best[2]


def _match(rows: pd.DataFrame) -> pd.DataFrame:
    tokens = int(rows["tokens"].iloc[0])
    # a window that matched in several forms gives the same values in each, and votes once
    same = [(p, q, frozenset(zip(a, b))) for p, q, a, b in zip(rows["doc_at"], rows["item_at"], rows["item_values"], rows["doc_values"])]
    rows = rows.loc[~pd.Series(same, index=rows.index).duplicated()]
    covered, first, anew = best_match(*(rows[c].tolist() for c in ("doc_at", "item_at", "doc_values", "item_values")), tokens)
    out = pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "item_id": [rows["item_id"].iloc[0]], "coverage": [covered / tokens], "word": [first], "slots_changed": [anew]})
    return out if DEN * covered >= NUM * tokens else out.iloc[:0]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, word, slots_changed) for each document that holds a benchmark item, re-parameterised or not.

    Texts are split at white space; numbers, units behind them and names become
    placeholders. Windows of 5 tokens are joined by hash in three forms: with placeholders
    and with placeholders for numbers and units alone, either with at least 2 words, and as
    plain lower-cased words. So texts in capitals or without any, and windows of nothing but numbers and names, are
    joined by their own words. An item is found
    if windows that fill its slots consistently cover 0.8 of its tokens or more within
    two item lengths. A text of fewer tokens is one window, so a short item is
    found in a text that consists of it and nothing else. ``word`` is where the stretch
    starts, ``slots_changed`` how many slot values differ from the item's.

    Null and empty texts, on either side, hold and are nothing; null ids take no part.
    Documents, or items, that share an id are one. Before the join, the documents' windows
    pass a filter of fixed size (2^24 bits) made of the benchmark's.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "leaks")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    names = ["item_id", "item_at", "h", "item_values", "tokens", "same"]
    items = ws.store(items.mapInArrow(_emit(names, None), _schema(names)).distinct(), "items")
    slots = items.select(F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("slot")).distinct().toPandas()["slot"]
    table = np.zeros(1 << FILTER_BITS, bool)
    table[slots.to_numpy(np.int64)] = True

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "doc_at", "h", "doc_values", "doc_tokens", "doc_same"]
    seen = docs.mapInArrow(_emit(names, np.packbits(table)), _schema(names)).drop("doc_tokens", "doc_same")
    # slot values of the item that a form holds as words stand in the document, too
    both = seen.join(items, "h").withColumns({c: F.concat(c, "same") for c in ("doc_values", "item_values")})
    pairs = ws.store(both.drop("h", "same"), "pairs")
    enough = pairs.groupBy("doc_id", "item_id").agg(F.countDistinct("item_at").alias("n"), F.max("tokens").alias("most"))
    enough = enough.where(F.col("n") * WINDOW * DEN >= F.col("most") * NUM).select("doc_id", "item_id")
    schema = "doc_id long, item_id long, coverage double, word long, slots_changed long"
    return pairs.join(enough, ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id").applyInPandas(_match, schema)
