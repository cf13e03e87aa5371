"""Pairs of open groups are ruled out by sketches inside the join, dense groups settled without checking each pair."""

import random

from pyspark.sql import functions as F

from fleetlens.llm import linking
from fleetlens.llm.line_dedup import _lines, _signatures, duplicate_lines
from fleetlens.llm.linking import link, open_pairs, sketches
from fleetlens.llm.workspace import Workspace

from .test_linking import roots


def verify(pairs):
    both = F.size("a_body") + F.size("b_body")
    return pairs.select("a", "b", F.size(F.array_intersect("a_body", "b_body")).cast("long").alias("common"), both.cast("long").alias("both"))


def linked(sets):
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})]
    return roots(pairs), pairs


def near_copies(draw, n, size, most):
    """Sets that lack up to ``most`` elements of one base, for others of their own."""
    base, out = list(range(size)), {}
    for k in range(n):
        gone = draw.randrange(most + 1)
        out[k] = draw.sample(base, size - gone) + [1000 * (k + 1) + i for i in range(gone)]
    return out


def test_no_link_is_ruled_out(llm):
    """Sketches of sets from 1 to 3000 elements: every linked pair of a group is left, few of the others are, none comes twice."""
    draw = random.Random(4)
    sets = {}
    for g, (size, most) in enumerate([(1, 0), (9, 2), (60, 20), (300, 90), (3000, 900)]):
        sets |= {100 * g + k: [h + g * 10**6 for h in s] for k, s in near_copies(draw, 24, size, most).items()}
    wanted = {p for p in linked(sets)[1]}
    shapes = sketches(llm.createDataFrame(list(sets.items()), "id long, set array<long>"))
    assert {r["id"]: r["n"] for r in shapes.select("id", "n").collect()} == {k: len(s) for k, s in sets.items()}
    members = llm.createDataFrame([(leader, k, k) for k in sets for leader in (-1, -2)], "leader long, id long, component long")
    for block in (4096, 7):
        got = [(r["a"], r["b"]) for r in open_pairs(members, shapes, 80, 100, block).collect()]
        assert len(got) == len({*got}) and wanted <= {*got} and len(got) < 120 * 119 // 4


def test_dense_group_is_not_checked_pair_by_pair(llm, monkeypatch):
    sets = near_copies(random.Random(9), 150, 100, 14)
    sets[-1] = list(range(10**6, 10**6 + 100))  # leads the bucket, unlike all others
    want, pairs = linked(sets)
    rows = llm.createDataFrame(list(sets.items()), "id long, body array<long>")
    buckets = [llm.createDataFrame([(key, k) for k in sets], "key long, id long") for key in (7, 8)]
    checked = {}
    for few in (1, 1 << 18):
        monkeypatch.setattr(linking, "FEW", few)
        compared = []

        def noted(pairs):
            out = verify(pairs)
            compared.append(out.count())
            return out

        got = link(buckets, lambda ids: rows.join(ids, "id", "left_semi"), noted, Workspace(llm, "dense"), sets=lambda body: body)
        assert {r["id"]: r["component"] for r in got.collect()} == want
        checked[few] = sum(compared)
    assert len(pairs) > 3000 and checked[1] < len(pairs) / 3 < len(pairs) <= checked[1 << 18]


def test_minima_of_several_shingles_a_row(llm, monkeypatch):
    docs = llm.createDataFrame([(1, "\n".join("".join(chr(97 + (k * k + n) % 23) for k in range(n)) for n in range(1, 60)))], "doc_id long, text string")
    from fleetlens.llm import line_dedup

    got = []
    for step in (2, 8):
        monkeypatch.setattr(line_dedup, "STEP", step)
        got.append(sorted((r["line_no"], tuple(r["bands"])) for r in _signatures(_lines(docs)).collect()))
    assert len(got[0]) == 59 and got[0] == got[1]


def test_variants_of_a_line_under_an_unlike_leader(llm):
    """600 variants of one line: what the join lets through doesn't grow with all pairs of the group."""
    draw = random.Random(2)
    words = ["".join(draw.choice("aeioustrn") for _ in range(6)) for _ in range(60)]
    texts = []
    for _ in range(600):
        w = list(words)
        for _ in range(4):
            w[draw.randrange(60)] = "".join(draw.choice("aeioustrn") for _ in range(6))
        texts.append(" ".join(w))
    rows = {}

    class Noted(Workspace):
        def store(self, df, name):
            out = super().store(df, name)
            rows[name] = out.count()
            return out

    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    duplicate_lines(docs, ws=Noted(llm, "variants"))
    assert rows["open"] > 300 and 0 < rows["unsettled--1"] < 600 * 599 / 2 / 8, rows


def test_bodies_that_come_twice(llm):
    """Documents that share an id and a text, and one of their ids with another text."""
    draw = random.Random(6)
    words = ["".join(draw.choice("aeioustrn") for _ in range(6)) for _ in range(40)]
    first, second = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(1, first), (1, first), (2, second), (2, second), (2, "short"), (3, second + "x")]
    got = duplicate_lines(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["drop"] for r in got} == {2: [0], 3: [0]}
