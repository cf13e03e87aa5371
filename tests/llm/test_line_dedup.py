import random

from fleetlens.llm.line_dedup import dedup_lines

from .test_linking import roots


def brute(rows):
    """Texts without the lines that an earlier one of their component makes superfluous."""
    lines = [(d, k, x.strip(" \t\r")) for d, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
    first = {}
    for d, k, x in sorted(lines):
        first.setdefault(x, (d, k))
    units = lambda x: x.encode("utf-16-be")
    grams = {x: {units(x)[2 * i : 2 * i + 16] for i in range(max(1, len(units(x)) // 2 - 7))} for x in first}
    texts = sorted(first)
    pairs = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if min(len(grams[a]), len(grams[b])) >= 0.8 * max(len(grams[a]), len(grams[b])) and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    comp = roots(pairs)
    keep = {}
    for x in texts:
        c = comp.get(x, x)
        keep[c] = min(keep.get(c, first[x]), first[x])
    late = {(d, k) for d, k, x in lines if (d, k) != keep[comp.get(x, x)]}
    out = {}
    for d, t in rows:
        n = 0 if t is None else len(t.split("\n"))
        drop = [k for k in range(n) if (d, k) in late]
        out[d] = (n, len(drop), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
    return out


def run(llm, rows):
    df = llm.createDataFrame([(i, "z", t, 3) for i, t in rows], "doc_id long, line_no string, text string, n_dropped int")
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(df).collect()]


def test_variants_of_lines(llm):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeioustrn") for _ in range(rnd.randrange(2, 9)))
    bases = [[word() for _ in range(n)] for n in (3, 8, 25, 60, 200, 1500)]
    rows = []
    for i in range(40):
        lines = []
        for b in bases:
            w = list(b)
            for _ in range(rnd.randrange(0, max(1, len(w) // 12) + 1)):
                w[rnd.randrange(len(w))] = word()
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines + [" ".join(word() for _ in range(20))])))
    got, want = {r[0]: r[1:] for r in run(llm, rows)}, brute(rows)
    assert sum(got[i] != want[i] for i in want) <= 1  # the bands miss few links


def test_odd_lines(llm):
    long = "b" + "ab" * 300_000
    rows = [(1, None), (2, ""), (3, "\n \n\n"), (4, "é\né\r\n x"), (5, "x"), (6, long), (7, "b" + "ab" * 40), (8, "été à la plage, déjà vu\n😀 ok")]
    rows = [(i, t if t is None else t.encode("utf-16", "surrogatepass").decode("utf-16")) for i, t in rows]
    got = {r[0]: r[1:] for r in run(llm, rows)}
    assert got == {1: (0, 0, None), 2: (1, 0, ""), 3: (4, 0, "\n \n\n"), 4: (3, 1, "é\n x"), 5: (1, 1, ""), 6: (1, 0, long), 7: (1, 1, ""), 8: (2, 0, rows[-1][1])}  # 6 and 7 hold the same shingles
    assert run(llm, []) == []


def test_repeated_and_null_ids(llm):
    got = sorted(run(llm, [(1, "same line here"), (1, "same line here"), (None, "same line here"), (2, "same line here")]), key=str)
    assert got == [(1, 1, 0, "same line here"), (1, 1, 0, "same line here"), (2, 1, 1, ""), (None, 1, 0, "same line here")]


def test_native_plan(llm, sf):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        dedup_lines(llm.read.parquet(f"{sf}/documents.parquet")).explain()
    assert not any(x in out.getvalue() for x in ("Python", "Arrow", "Pandas"))


def test_whole_table_against_brute_force(llm, sf):
    from fleetlens.llm.queries import op7_line_dedup

    docs = llm.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(docs).collect()} == want
    got = op7_line_dedup(llm, sf).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {i: w[1] for i, w in want.items()} and all(len(r["dropped_lines"]) == r["n_dropped"] for r in got)
