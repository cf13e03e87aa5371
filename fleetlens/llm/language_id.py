"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 400  # documents of a language that the fit expects to take; the bound on what it learns from
LANGUAGES = 200  # more labels than this are refused
LONGEST = 8  # bytes of a piece
CHUNK = 32  # bytes of a word that are scored together; a product of this many probabilities stays above the smallest double
ROUNDS = 4
SMOOTHING = 0.01
BASE = np.uint64(0x100000001B3)
LETTER = re.compile(r"[^\W\d_]")


def _roll(code: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (code + byte.astype(np.uint64) + np.uint64(1)) * BASE


class Pieces:
    """The vocabulary's pieces of up to LONGEST bytes, found by a rolling code in a sorted table."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pieces = [p for p in (base64.b64decode(line.split()[0]) for line in lines) if len(p) <= LONGEST]
        codes = []
        for p in pieces:
            code = np.zeros(1, np.uint64)
            for b in p:
                code = _roll(code, np.array([b]))
            codes.append(code[0])
        order = np.argsort(codes)
        self.codes, self.none = np.array(codes, np.uint64)[order], len(codes)
        assert (np.diff(self.codes) > 0).all(), "two pieces have one code"

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        at[at == self.none] = 0
        return np.where(self.codes[at] == codes, at, self.none)

    def lattice(self, words: np.ndarray) -> list[list[np.ndarray]]:
        """[start][length - 1]: the piece of each word there, for words (rows) of equal length."""
        n, out = words.shape[1], []
        for i in range(n):
            code, row = np.zeros(len(words), np.uint64), []
            for j in range(i, min(n, i + LONGEST)):
                code = _roll(code, words[:, j])
                row.append(self.find(code))
            out.append(row)
        return out


def chunks(text: str) -> list[bytes]:
    """Words in lower case with a blank in front, cut every CHUNK bytes."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    out: list[bytes] = []
    for word in words:
        if len(word) < CHUNK:
            out.append(b" " + word)
        else:
            word = b" " + word
            out += [word[i : i + CHUNK] for i in range(0, len(word), CHUNK)]
    return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for part in np.array_split(at, len(at) // 20_000 + 1):
            yield part, np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), n)


def forward(lattice: list[list[np.ndarray]], prob: np.ndarray, words: int) -> list[np.ndarray]:
    """alpha[i]: probability of the first i bytes, summed over their segmentations; a column per language."""
    n = len(lattice)
    alpha = [np.ones((words, prob.shape[1]))] + [np.zeros((words, prob.shape[1])) for _ in range(n)]
    for i in range(n):
        for k, piece in enumerate(lattice[i]):
            alpha[i + k + 1] += alpha[i] * prob[piece]
    return alpha


def fit_pieces(pieces: Pieces, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over all segmentations."""
    prob = np.append(np.full(pieces.none, 1 / pieces.none), 0)
    groups = [(at, pieces.lattice(grid)) for at, grid in _by_length(words)]
    for _ in range(ROUNDS):
        total, column = np.zeros(pieces.none + 1), prob[:, None]
        for at, lattice in groups:
            alpha = [a[:, 0] for a in forward(lattice, column, len(at))]
            n = len(lattice)
            beta = [np.zeros(len(at)) for _ in range(n)] + [np.ones(len(at))]
            weight = counts[at] / np.maximum(alpha[n], 1e-300)
            for i in range(n - 1, -1, -1):
                for k, piece in enumerate(lattice[i]):
                    beta[i] += prob[piece] * beta[i + k + 1]
                    np.add.at(total, piece, alpha[i] * prob[piece] * beta[i + k + 1] * weight)
        total = total[:-1] + SMOOTHING
        prob = np.append(total / total.sum(), 0)
    return prob[:-1]


@dataclass(frozen=True)
class Model:
    """Languages and, a column for each, the probabilities of the vocabulary's pieces (a last row of zeros for no piece)."""

    path: str
    languages: list[str]
    prob: np.ndarray


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _fit(path: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        for text in rows["text"]:
            for word in chunks(text):
                seen[word] = seen.get(word, 0) + 1
        pieces = _pieces(path)
        prob = fit_pieces(pieces, list(seen), np.fromiter(seen.values(), np.float64, len(seen)))
        return pd.DataFrame({"lang": [key[0]], "prob": [prob]})

    return run


def fit(docs: DataFrame, path: str, train: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """A model of the languages named in ``lang_col``, learnt from the rows for which ``train`` holds.

    Of each language about SAMPLE documents are taken, whole, by the hash of their
    id: those below a threshold set by the language's count. Rows with a null
    language, id or text aren't learnt from. None if there is nothing to learn.
    """
    rows = docs.where(train).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("id is not null and lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, SAMPLE / r["n"]))))
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text")
    fitted = sorted(sample.groupBy("lang").applyInPandas(_fit(path), "lang string, prob array<double>").collect())
    if not fitted:
        return None
    prob = np.array([r["prob"] for r in fitted]).T
    return Model(path, [r["lang"] for r in fitted], np.vstack([prob, np.zeros(prob.shape[1])]))


def log_likelihoods(model: Model, texts: list[str]) -> np.ndarray:
    """Row per text, column per language. Each distinct word of the texts is scored once."""
    index: dict[bytes, int] = {}
    words = [[index.setdefault(w, len(index)) for w in chunks(t)] for t in texts]
    known, score = list(index), np.zeros((len(index), len(model.languages)))
    for at, grid in _by_length(known):
        score[at] = np.log(forward(_pieces(model.path).lattice(grid), model.prob, len(at))[-1])
    return np.array([score[w].sum(axis=0) if w else np.zeros(score.shape[1]) for w in words]).reshape(len(texts), -1)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            known = [k for k, t in enumerate(texts) if model and t and LETTER.search(t)]
            if known:
                logs = log_likelihoods(model, [texts[k] for k in known])
                share = np.exp(logs - logs.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                for k, best, p in zip(known, logs.argmax(axis=1), share.max(axis=1)):
                    lang[k], score[k] = model.languages[best], float(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; score is the posterior of the language under equal priors.

    The whole text counts: every word, over all its segmentations into pieces.
    ``und`` with score 0 if the text is null or has no letter, or the model is None.
    A null id is carried. Other columns are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang and score set by the prediction (columns of these names are replaced); other columns stay."""
    rest = [c for c in docs.columns if c not in ("lang", "score")]
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (found,) = _predict(model)(iter([batch.select([at, at])]))
            columns = [*batch.columns, *found.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "lang", "score"])

    schema = docs.select(*rest).schema.add("lang", "string").add("score", "double")
    return docs.select(*rest).mapInArrow(run, schema)
