import random

import numpy as np
from fleetlens.llm import superminhash
from fleetlens.llm.text_hash import mix, stride

from .test_linking import roots

SCHEMA = "doc_id long, text string, component_id string"


def plain_signature(elements, slots):
    """The method one element and one level at a time."""
    out = [2**64 - 1] * slots
    for e in elements:
        order = list(range(slots))
        for level in range(slots):
            draw = int(mix(np.array([e], np.uint64) + stride(level + 1))[0])
            at = level + ((draw & 0xFFFFFFFF) * (slots - level) >> 32)
            order[level], order[at] = order[at], order[level]
            out[order[level]] = min(out[order[level]], level << 32 | draw >> 32)
    return out


def test_early_stop_changes_nothing():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 300)]
    got = superminhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 16)
    assert [list(map(int, row)) for row in got] == [plain_signature(s.tolist(), 16) for s in sets]


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 2**63, 1000).astype(np.uint64)
    sets = [x[:900], x[100:]]
    a, b = superminhash.signatures(np.concatenate(sets), np.array([900, 900]))
    assert abs((a == b).mean() - 0.8) < 0.12


def brute(rows, words):
    """Components and set sizes by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = roots(pairs)
    return {i: (len(sets[i]), comp.get(i, i), comp.get(i, i) == i) for i in ids}


def run(llm, rows, **more):
    df = llm.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return sorted(map(tuple, superminhash.near_duplicates(df, **more).collect()), key=lambda r: (r[0] is None, r))


def test_chains_copies_and_hard_pairs(llm):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # one large group, each text edited by itself: many pairs just miss
        w = list(base)
        for _ in range(rnd.randrange(0, 8)):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(30)]
    step = [word() for _ in range(80)]
    for i in range(12):  # a chain: neighbours are alike, its ends aren't
        rows.append((200 + i, " ".join(step)))
        step = step[:]
        step[5 * i + 3] = word()
    rows += [(300 + i, " ".join(word() for _ in range(60))) for i in range(40)]
    want = brute(rows, 4)
    assert {r[0]: r[1:] for r in run(llm, rows, words=4)} == want


def test_odd_texts(llm):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one\u000btwo"), (6, "one two"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, "x " * 50_000), (9, "x " * 60_000)]
    got = run(llm, rows, words=4)
    assert [(r[0], *r[1:]) for r in got] == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
        (7, 2, 7, True), (7, 2, 7, True), (8, 1, 8, True), (9, 1, 8, False), (None, 2, None, True),
    ]
    assert run(llm, []) == []


def test_whole_table_against_brute_force(llm, sf):
    from fleetlens.llm.queries import op5_superminhash

    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r[0]: tuple(r[1:]) for r in op5_superminhash(llm, sf).collect()} == brute(rows, 4)
