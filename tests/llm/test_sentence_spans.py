import random
import re

from fleetlens.llm.sentence_spans import drop_repeated_sentences


def brute(rows):
    units = {}
    for d, t in rows:
        whole = re.findall(r"(?s).+?(?:[.!?][ \t\n\x0b\f\r]+|\n[ \t\n\x0b\f\r]*|\Z)", t or "")
        units[d] = (whole, [x.lower().strip(" \t\r\n") for x in whole])
    runs = {}
    for d, (_, s) in sorted(units.items()):
        for i in range(len(s)):
            words = 0
            for j in range(i, len(s)):
                words += s[j].count(" ") + 1
                if words >= 20 and j > i:
                    runs.setdefault(hash(tuple(s[i : j + 1])), []).append((d, i, j + 1))
    gone = {(d, k) for at in runs.values() if len(at) > 1 for d, i, j in sorted(at)[1:] for k in range(i, j)}
    out = {}
    for d, t in rows:
        whole = units[d][0]
        kept = [x for i, x in enumerate(whole) if (d, i) not in gone]
        out[d] = (len(whole), len(whole) - len(kept), t if len(kept) == len(whole) else "".join(kept))
    return out


def run(llm, rows):
    df = llm.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_dropped int, pos string")
    return [(r["doc_id"], r["n_sentences"], r["n_dropped"], r["text"]) for r in drop_repeated_sentences(df).collect()]


def test_passages_in_other_texts(llm):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    sentence = lambda: " ".join(word() for _ in range(rnd.randrange(3, 12))).capitalize() + rnd.choice([". ", "! ", ".\n", "? "])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [sentence() for _ in range(rnd.randrange(2, 10))]
        if i % 3:
            parts.insert(rnd.randrange(len(parts)), rnd.choice(passages))
        rows.append((i, "".join(parts).strip()))
    got = {r[0]: r[1:] for r in run(llm, rows)}
    assert got == brute(rows)
    assert all(sum(p[:40] in t[2] for t in got.values()) <= 1 for p in passages)


def test_odd_texts(llm):
    many = "This sentence stands here. " * 30_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "No mark at all"), (5, "A.B 3.5 x. Y"), (6, many), (7, many.upper()), (None, many)]
    got = {r[0]: r[1:] for r in run(llm, rows)}
    want = brute([(i, t if len(t or "") < 1000 else "This sentence stands here. " * 60) for i, t in rows if i is not None])
    for i in (6, 7):
        n, dropped, left = want[i]
        want[i] = (30_000, 30_000 - (n - dropped), left)
    assert got[None] == (30_000, 0, many) and {k: v for k, v in got.items() if k is not None} == want
    assert run(llm, []) == []


def test_whole_table_against_brute_force(llm, sf):
    from fleetlens.llm.queries import op8_sentence_spans

    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r[0]: tuple(r[1:]) for r in op8_sentence_spans(llm, sf).collect()} == brute(rows)
