"""Byte BPE, token counts, licences, language ID and decontamination."""

import base64
import hashlib
import itertools
import math
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fleetlens.llm import byte_bpe, decontamination, language_id, licenses, queries, token_counts

SCHEMA = "doc_id long, text string, n_tokens string, license int"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a" * 200_000), (5, "Hello  wörld 😀 don't 123456\r\n"), (5, "twice"), (None, "no id"), (6, "<|endoftext|> x"), (7, "ab" * 50_000 + " " * 30_000), (8, "zu" + "ção" * 1000)]


@pytest.fixture(scope="module")
def library():
    with open(queries.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd(llm):
    return llm.createDataFrame([(i, t, "x", 1) for i, t in ODD], SCHEMA)


def texts(llm, sf):
    return {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}


def test_bpe_equals_the_library(llm, sf, library):
    want = {i: library.encode_ordinary(t) for i, t in texts(llm, sf).items()}
    packed = {i: struct.pack(f"<{len(x)}I", *x) for i, x in want.items()}
    got = {r["doc_id"]: r for r in queries.op6_byte_bpe(llm, sf).collect()}
    assert {i: (r["n_tokens"], r["ids_sha256"]) for i, r in got.items()} == {i: (len(want[i]), hashlib.sha256(p).hexdigest()) for i, p in packed.items()}
    assert {i: r["decoded_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts(llm, sf).items()}


def test_bpe_of_odd_texts(llm, library):
    rows = byte_bpe.encode_documents(odd(llm), queries.RANKS, queries.PATTERN).collect()
    want = sorted((str(i), tuple(library.encode_ordinary(t or ""))) for i, t in ODD)
    assert sorted((str(r["doc_id"]), struct.unpack(f"<{r['n_tokens']}I", r["ids"])) for r in rows) == want
    assert byte_bpe.encode_documents(odd(llm).limit(0), queries.RANKS, queries.PATTERN).collect() == []


def test_bpe_of_random_bytes(library):
    bpe, rnd = byte_bpe.encoder(queries.RANKS, queries.PATTERN), random.Random(4)
    for n in (1, 2, 9, 60, 700):
        for alphabet in ("ab", "etaoin shrdlu", "éàß漢字 12", "aA \n"):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            packed = bpe.encode(text)
            assert struct.unpack(f"<{len(packed) // 4}I", packed) == tuple(library.encode_ordinary(text))
            assert bpe.decode(packed) == text.encode()


def test_queue_gives_the_lowest_rank_and_leftmost_position():
    rnd, queue, held = random.Random(1), byte_bpe.RankQueue(), []
    for _ in range(2000):
        if held and rnd.random() < 0.45:
            low = min(held)
            held.remove(low)
            assert queue.pop() == low
        else:
            entry = (rnd.randrange(60_000), rnd.randrange(100))
            held.append(entry)
            queue.push(*entry)


def test_token_counts(llm, sf, library, monkeypatch):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op9_token_counts(llm, sf).collect()}
    assert got == {i: len(library.encode_ordinary(t)) for i, t in texts(llm, sf).items()}
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 1000)  # documents over many blocks, blocks without an end
    monkeypatch.setattr(token_counts, "FILE_TOKENS", 40_000)
    rows = token_counts.document_tokens(odd(llm).coalesce(1), queries.RANKS, queries.PATTERN, queries.SEPARATOR).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((str(i), len(library.encode_ordinary(t or ""))) for i, t in ODD)
    assert token_counts.document_tokens(odd(llm).limit(0), queries.RANKS, queries.PATTERN, queries.SEPARATOR).collect() == []


def plain_licences(rows, templates):
    """The best containment over all stretches as long as a window."""
    out = {}
    sets = {n: list(licenses._shingles(t)) for n, t in templates.items()}
    for i, t in rows:
        s = licenses._shingles(t).tolist()
        for name, want in sets.items():
            w = set(want)
            span = 2 << (len(w) - 1).bit_length()
            best = max((len(w & set(s[k : k + span])) for k in range(len(s))), default=0)
            if best >= 0.8 * len(w):
                out[(i, name)] = best / len(w)
    return out


def test_licences(llm, sf):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for i, (name, text) in enumerate(licenses.NOTICES.items()):
        filler = " ".join(word() for _ in range(rnd.randrange(0, 90)))
        edited = text.split()
        edited[len(edited) // 2] = word()
        rows += [(i, f"{filler} {text.upper()} {filler}"), (100 + i, f"{filler}\n{' '.join(edited)}\n{text[:30]}"), (200 + i, filler)]
    df = llm.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan_licenses(df).collect()}
    want = plain_licences(rows, licenses.NOTICES)
    assert set(got) >= {(i, n) for i, n in enumerate(licenses.NOTICES)} and set(got) <= set(want)
    assert {k for k, c in want.items() if c == 1} <= set(got)
    assert licenses.scan_licenses(odd(llm)).collect() == []
    table = texts(llm, sf)
    assert {(r["doc_id"], r["license"]) for r in queries.op3_licenses(llm, sf).collect()} == set(plain_licences(table.items(), licenses.NOTICES))


def test_forward_sums_all_segmentations(tmp_path):
    path = tmp_path / "v"
    pieces = [b" ", b"a", b"b", b"ab", b"ba", b" a", b"aba"]
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % k for k, p in enumerate(pieces)))
    known = language_id.Pieces(str(path))
    rng, chance = np.random.default_rng(1), {}
    prob = np.zeros((known.none + 1, 2))
    for p in pieces:
        code = np.zeros(1, np.uint64)
        for b in p:
            code = language_id._roll(code, np.array([b]))
        chance[p] = rng.random(2)
        prob[known.find(code)[0]] = chance[p]
    for word in (b" abab", b" a", b" bbaba"):
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(word)), k) for k in range(len(word)))
        total = np.zeros(2)
        for cut in cuts:
            parts = [word[i:j] for i, j in zip((0, *cut), (*cut, len(word)))]
            if all(p in chance for p in parts):
                total += math.prod(chance[p] for p in parts)
        grid = np.frombuffer(word, np.uint8).reshape(1, -1)
        assert np.allclose(language_id.forward(known.lattice(grid), prob, 1)[-1][0], total)


def test_language_id(llm, sf):
    rows = queries.op4_language_id(llm, sf).collect()
    truth = {r["doc_id"]: r for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows) and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_language_id_of_odd_texts(llm):
    train = llm.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "fr"), ("x", None)] * 5)], "doc_id long, text string, lang string")
    model = language_id.fit(train, queries.RANKS, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd(llm), model).collect()}
    assert model.languages == ["en", "fr"] and [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] in model.languages
    assert language_id.fit(train.limit(0), queries.RANKS, F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(odd(llm), None).collect()} == {"und"}
    assert language_id.predict(odd(llm).limit(0), model).collect() == []


def test_leaks(llm):
    items = [
        (1, "When did Alice Miller buy 12 apples and 3 pears for 40 cents at the market near the old river bridge?"),
        (2, "The train leaves the station at noon and travels north for several hours until it reaches the coast."),
        (3, "Yes indeed."), (4, None), (5, ""), (None, "nothing that has an id"), (2, "The train leaves the station at noon and travels north for several hours until it reaches the coast."),
    ]
    pad = "some other words that stand around it in this text. "
    rows = [
        (1, pad + items[0][1] + " " + pad),
        (2, pad + "When did Bob Stone buy 7 apples and 5 pears for 99 cents at the market near the old river bridge? " + pad),
        (3, pad + "the TRAIN leaves the station at noon, and travels north for several days until it reaches the coast."),
        (4, pad * 3), (5, "yes indeed"), (6, pad + "Yes indeed. " + pad), (7, None), (8, ""), (None, items[1][1]),
        (9, "The train leaves the station at noon and travels north " + pad * 30 + "for several hours until it reaches the coast."),
        (10, pad * 20_000 + items[1][1]),
    ]
    docs = llm.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    bench = llm.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, word int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 3), (10, 2)}
    assert got[(1, 1)]["slots_changed"] == 0 and got[(2, 1)]["slots_changed"] == 5 and got[(10, 2)]["coverage"] >= 0.9
    assert decontamination.find_leaks(docs.limit(0), bench).collect() == [] and decontamination.find_leaks(docs, bench.limit(0)).collect() == []


def test_slots_must_agree():
    """Ten windows give value 1 the meaning 7; one that says otherwise doesn't count."""
    at = list(range(10))
    covered, first, anew = decontamination.best_match([*at, 10], [*at, 10], [[7]] * 10 + [[8]], [[1]] * 11, 15)
    assert (covered, first, anew) == (14, 0, 1)


def test_leaks_in_the_whole_table(llm, sf):
    """Every verbatim item is found, and nothing that shares less than most of its words in order."""
    table = texts(llm, sf)
    items = {r["item_id"]: r["text"] for r in llm.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(llm, sf).collect()}
    assert {(d, i) for d, t in table.items() for i, x in items.items() if x in t} <= got
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)}
    assert all(len(grams(items[i]) & grams(table[d])) >= 0.5 * len(grams(items[i])) for d, i in got)
