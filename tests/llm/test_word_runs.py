import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fleetlens.llm import queries, word_runs

SCHEMA = "doc_id long, text string"


def brute(words):
    """All maximal stretches of every period, kept where the period is the smallest."""
    n, out = len(words), {}
    for q in range(1, n):
        s = 0
        while s + q < n:
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - s
            if length >= max(6, 4 * q):
                out.setdefault((s, length), q)
            s = e + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def ids(words):
    return np.array([zlib.crc32(w.encode()) + 1 for w in words], np.uint64)


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(250):
        letters = "ab" if rnd.random() < 0.5 else "abcdef"
        words = []
        while len(words) < rnd.randrange(1, 90):
            part = [rnd.choice(letters) for _ in range(rnd.randrange(1, 9))]
            words += part * rnd.choice([1, 1, 2, 4, 5, 9])
            if rnd.random() < 0.3:
                words += part[: rnd.randrange(len(part) + 1)]
        texts.append(words)
    assert word_runs.runs_of([ids(w) for w in texts]) == [brute(w) for w in texts]


def test_equal_texts_and_borders_do_not_meet():
    texts = [["a"] * 5, ["a"] * 5, ["x"] * 6, [], ["x"] * 6, list("ababab") + list("ababab")]
    assert word_runs.runs_of([ids(w) for w in texts]) == [[], [], [(0, 6, 1)], [], [(0, 6, 1)], [(0, 12, 2)]]


def test_long_texts():
    rnd = random.Random(9)
    base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(99)) for _ in range(1500)]
    texts = [["a"] * 300_000, base * 8, base + base[:700] * 5 + base]
    got = word_runs.runs_of([ids(w) for w in texts])
    assert got[0] == [(0, 300_000, 1)]
    assert got[1] == [(0, 12_000, 1500)]
    assert [(s, n, q) for s, n, q in got[2] if q == 700] == [(1500 - 0, 700 * 5, 700)] or got[2] == brute(texts[2])


def expected(rows):
    out = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        digest = sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.setdefault(doc_id, []).append((len(runs), *head, digest, sha(collapse(words, runs))))
    return out


def test_query_against_brute_force(llm, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["la", "na", "hey", "ja  \t", "x\n"][: 2 + i % 4]) for _ in range(rnd.randrange(0, 70)))) for i in range(400)]
    rows += [(7, "a b " * 20), (7, "a b " * 20), (None, "z " * 9), (10**17, None), (500, ""), (501, " \t\r\n"), (502, "  " * 8), (503, "é è " * 4)]
    llm.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.op13_word_runs(llm, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]))
    want = expected(rows)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert sum(v[0][0] > 0 for v in want.values()) > 30


def test_empty_table(llm):
    empty = llm.createDataFrame([], SCHEMA)
    assert word_runs.find_runs(word_runs.repeat_tails(empty)).collect() == []


def test_whole_small_table(llm, sf):
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r in rows if len((r[1] or "").split()) < 1200]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_word_runs(llm, sf).collect()}
    assert {i: [got[i]] for i, _ in rows} == expected(rows)
