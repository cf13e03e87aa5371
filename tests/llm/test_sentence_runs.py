"""Every run of consecutive sentences counts, not only the shortest from each sentence."""

import random

from fleetlens.llm.sentence_spans import PIECE, _keys, drop_repeated_sentences


def dropped(rows):
    """Sentences that a repeated run of any length covers."""
    runs, gone = {}, {}
    for d, t in rows:
        s = [x.strip(" \t\r\n") for x in PIECE.findall(t.lower())]
        for i in range(len(s)):
            for j in range(i + 2, len(s) + 1):
                if sum(x.count(" ") + 1 for x in s[i:j]) >= 20:
                    runs.setdefault(tuple(s[i:j]), []).append((d, i))
    for key, at in runs.items():
        for d, i in sorted(at)[1:]:
            gone.setdefault(d, set()).update(range(i, i + len(key)))
    return {d: len(x) for d, x in gone.items()}


def test_short_last_sentence_of_a_passage(llm):
    say = lambda w, n: " ".join(f"{w}{k}" for k in range(n)) + ". "
    passage = say("one", 15) + say("two", 15) + say("three", 3)
    rows = [(1, passage + say("end", 12)), (2, say("start", 9) + passage + say("other", 30))]
    got = {r["doc_id"]: r for r in drop_repeated_sentences(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_dropped"], got[2]["n_dropped"]) == (0, 3) and got[2]["text"] == say("start", 9) + say("other", 30)


def test_all_runs_by_brute_force(llm):
    rnd = random.Random(8)
    pool = [" ".join(rnd.choice("abcdef") * 4 for _ in range(rnd.randrange(1, 18))) + ". " for _ in range(40)]
    rows = [(d, "".join("".join(pool[k : k + rnd.randrange(1, 9)]) for k in rnd.choices(range(len(pool)), k=6))) for d in range(60)]
    got = {r["doc_id"]: r["n_dropped"] for r in drop_repeated_sentences(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dropped(rows)
    assert want and got == {d: want.get(d, 0) for d, _ in rows}


def test_runs_are_emitted_once():
    rnd = random.Random(9)
    for _ in range(200):
        text = "".join("w " * rnd.randrange(0, 14) + "w. " for _ in range(rnd.randrange(0, 12)))
        at = [(i, n) for i, n, _ in _keys(text)]
        assert len(at) == len(set(at))
