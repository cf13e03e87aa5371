import math
import random
import re

import numpy as np
import pytest

from fleetlens.llm import best_position, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=50):
    split = [(i, terms(t)) for i, t in docs]
    total, length = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    for item, wanted in asked.items():
        rows = []
        for doc_id, t in split:
            if doc_id is None or not t:
                continue
            m = 100 - 50 + (50 * len(t) * total) // length
            score = 0
            for w in wanted:
                if tf := t.count(w):
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                rows.append((-score, doc_id))
        out += [(item, n + 1, d, -s) for n, (s, d) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def collect(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(8))
def test_stop_keeps_the_best_and_their_ties(seed):
    rnd = np.random.default_rng(seed)
    n, k = 3000, 20
    owner, term = np.divmod(np.flatnonzero(rnd.random(n * 12) < np.tile(rnd.random(12) ** 3, n)), 12)
    impact = rnd.integers(1, [10, 1000][seed % 2], len(term))
    lists = best_position._Lists(n, owner, term, impact)
    for wanted in ([0, 3, 5, 99], list(range(12)), [7]):
        total = np.zeros(n, np.int64)
        use = np.isin(term, wanted)
        np.add.at(total, owner[use], impact[use])
        docs, scores = best_position.best_positions(lists, wanted, k)
        assert (total[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
        want = sorted(zip(-total, range(n)))[:k]
        assert [d for s, d in want if s] == [d for s, d in sorted(zip((-scores).tolist(), docs.tolist()))[:k] if s]


def test_reading_stops_early():
    n = 100_000
    impact = np.concatenate([np.arange(n, 0, -1), np.arange(n, 0, -1)])
    lists = best_position._Lists(n, np.concatenate([np.arange(n)] * 2), np.repeat([0, 1], n), impact)
    assert len(best_position.best_positions(lists, [0, 1], 50)[0]) < 500


def test_odd_rows_against_brute_force(llm, monkeypatch):
    monkeypatch.setattr(best_position, "POSTINGS", 300)
    monkeypatch.setattr(best_position, "ITEM_TERMS", 30)
    rnd = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "ünï", "Ünï", "x1", "9", " ", "漢字", "İ", "zz_y", "a-b", "\x00q"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 30)))) for i in range(400)]
    docs += [(3, docs[3][1]), (3, "alpha beta"), (None, "alpha"), (900, None), (901, ""), (902, ".,;\n"), (903, "alpha " * 5000)]
    items = [(i, " ".join(rnd.choices(words, k=6))) for i in range(25)] + [(3, "beta"), (None, "alpha"), (77, None), (78, "??"), (79, "nowhere")]
    d = llm.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    b = llm.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert collect(best_position.search(d, b)) == brute(docs, items)
    assert collect(best_position.search(d, b, k=3)) == brute(docs, items, 3)


def test_empty_tables(llm):
    docs, items = llm.createDataFrame([(1, "a b")], "doc_id long, text string"), llm.createDataFrame([(1, "a")], "item_id long, text string")
    assert collect(best_position.search(docs.limit(0), items)) == []
    assert collect(best_position.search(docs, items.limit(0))) == []
    assert best_position.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert collect(best_position.search(docs, items)) == brute([(1, "a b")], [(1, "a")])


def test_whole_small_table(llm, sf):
    docs, items = ([tuple(r) for r in llm.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert collect(queries.op12_best_position(llm, sf)) == brute(docs, items)
