"""Items in texts whose capitals differ, and windows of nothing but placeholders."""

import itertools

import pyarrow as pa
import regex
import xxhash

from fleetlens.llm import decontamination

ITEMS = [
    (1, "When did Alice Miller buy 12 apples and 3 pears for 40 cents at the market near the old river bridge?"),
    (2, "Which of Anna Bell, Carl Dorn, Emil Frank, Gina Hall, Ivan Jones, Kate Lind and Mary Nolan won?"),
    (3, "Add 17 23 41 59 61 73 89 97 101 113 127 131 149 now."),
]
PAD = "some other words that stand around it in this text. "


def leaks(llm, rows):
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(docs, llm.createDataFrame(ITEMS, "item_id long, text string")).collect()}


def test_copies_in_capitals_or_without_any(llm):
    rows = [(10 * i + k, f(PAD + t + " " + PAD)) for i, t in ITEMS for k, f in enumerate([str, str.upper, str.lower, str.title])]
    got = leaks(llm, rows)
    assert set(got) == {(10 * i + k, i) for i, _ in ITEMS for k in range(4)}
    assert all(r["slots_changed"] == 0 and r["coverage"] == 1 for r in got.values())


def test_other_numbers_in_capitals_or_without_any(llm):
    text = PAD + "When did Alice Miller buy 15 apples and 8 pears for 66 cents at the market near the old river bridge? " + PAD
    got = leaks(llm, [(k, f(text)) for k, f in enumerate([str, str.upper, str.lower])])
    assert {k: r["slots_changed"] for k, r in got.items()} == {(0, 1): 3, (1, 1): 3, (2, 1): 3}


def test_names_as_words_must_agree_with_names_as_slots():
    """Eight windows turn the name 5 into 6; a window that holds it as a word, 5, doesn't count."""
    at = list(range(8))
    assert decontamination.best_match([*at, 10], [*at, 10], [[6]] * 8 + [[5]], [[5]] * 9, 15) == (12, 0, 1)


def windows(rows, table=None):
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["id", "text"])
    out = []
    for part in decontamination._emit(list("abcdef"), table)(iter([batch])):
        out += [tuple(map(str, r.values())) for r in part.to_pylist()]
    return sorted(out)


def test_texts_are_gone_through_together(monkeypatch):
    calls, hashes = [], decontamination._hashes
    monkeypatch.setattr(decontamination, "_hashes", lambda *a: calls.append(1) or hashes(*a))
    odd = [None, "", " ", "one", "12 km", "Two Words.", "a 3 km B", "1 2 3 4", "it cost 5 $ and Ann left. Bob saw 7 kg in May", "ÄÖ «Émile» ١٢ km, x"]
    rows = [(k, odd[k % len(odd)]) for k in range(400)] + [(None, t) for _, t in ITEMS] + [(400 + i, t) for i, t in ITEMS]
    together = windows(rows)
    assert len(calls) < 40
    assert together == sorted(w for row in rows for w in windows([row]))
    monkeypatch.setattr(decontamination, "TOGETHER", 50, raising=False)
    assert windows(rows) == together


def test_tokens_are_cut_as_the_patterns_say():
    ends = regex.compile(r"[.!?:][\"'»”)\]]*$")
    pieces = [chr(c) for c in range(33, 127)] + ["a", "Bc", "12", "%", "°", "€5", "É", "ß", "»", "”", "²", "½", "中", "٣", "\x01"]
    for a, b, c in itertools.product(pieces, ["", "x", "7", ".", "%"], pieces):
        raw, tokens = a + b + c, decontamination.Tokens()
        at = tokens[raw]
        bare = decontamination.EDGES.sub("", raw) or raw
        number = bool(decontamination.DIGITS.match(bare))
        kind = number | 2 * (bare.lower() in decontamination.UNITS) | 4 * (not number and bare[:1].isupper()) | 8 * bool(ends.search(raw))
        assert (tokens.kind[at], tokens.word[at]) == (kind, xxhash.xxh64_intdigest(bare.lower()) | 8), raw
