"""Buckets whose pairs were all compared are settled, and only elements of several components are ordered."""

from pyspark.sql import functions as F

from fleetlens.llm.line_dedup import _compare, _shingles
from fleetlens.llm.linking import link
from fleetlens.llm.workspace import Workspace


class Noted(Workspace):
    def __init__(self, spark, name):
        super().__init__(spark, name)
        self.rows = {}

    def store(self, df, name):
        out = super().store(df, name)
        self.rows[name] = out.count()
        return out


def verify(pairs):
    both = F.size("a_body") + F.size("b_body")
    return pairs.select("a", "b", F.size(F.array_intersect("a_body", "b_body")).cast("long").alias("common"), both.cast("long").alias("both"))


def run(llm, sets, buckets, size_in_bucket):
    rows = llm.createDataFrame(list(sets.items()), "id long, body array<long>")
    sized = rows.withColumn("n", F.size("body"))
    keys = llm.createDataFrame(buckets, "key long, id long")
    ws = Noted(llm, "open")
    fetch = lambda ids: (rows if size_in_bucket else sized).join(ids, "id", "left_semi")
    if size_in_bucket:
        keys = keys.join(sized.select("id", "n"), "id")
    got = link(keys, fetch, verify, ws, elements=lambda body: body)
    return {r["id"]: r["component"] for r in got.collect()}, ws.rows


def test_pair_that_was_compared_is_settled(llm):
    sets = {k: [100 * k + i for i in range(10)] for k in range(6)}
    for sized in (True, False):
        got, rows = run(llm, sets, [(1, 0), (1, 1), (2, 2), (2, 3), (3, 4), (3, 5)], sized)
        assert got == {} and rows["star"] == 3 and rows["open"] == 0


def test_elements_of_one_component(llm):
    """Copies of two sets under one leader; the 60 elements that only one component holds aren't carried on."""
    a, b = list(range(20)), list(range(100, 120))
    sets = {0: list(range(500, 520))}
    sets |= {k: a + [30 + k] for k in range(1, 6)} | {k: b + [130 + k] for k in range(6, 11)}
    sets |= {11: a + [50, 51, 52, 200], 12: a[:10] + b[:10] + [200]}  # 11 is linked with the first ones
    for sized in (True, False):
        buckets = [(7, k) for k in sets] + [(8, k) for k in (*range(1, 6), 11)] + [(9, k) for k in range(6, 11)]
        got, rows = run(llm, sets, buckets, sized)
        assert got == {**{k: 1 for k in (*range(1, 6), 11)}, **{k: 6 for k in range(6, 11)}}
        held, first = (sum(n for name, n in rows.items() if name.startswith(kind)) for kind in ("held-", "prefixes-"))
        assert 0 < held <= 21 and 0 < first <= 30


def test_sizes_measured_once(llm):
    """Bodies that carry their size: pairs ruled out by it aren't verified."""
    sets = {0: list(range(10)), 1: list(range(10)) + [50], 2: list(range(100))}
    got, rows = run(llm, sets, [(1, 0), (1, 1), (1, 2)], False)
    assert got == {0: 0, 1: 0} and rows["star"] == 1


def test_compare_of_lines(llm):
    pairs = llm.createDataFrame([(1, 2, "abcdefghij", "abcdefghi")], "a long, b long, a_body string, b_body string")
    assert _compare(pairs).collect() == [(1, 2, 2, 5)]
    assert pairs.select(F.size(_shingles(F.col("a_body")))).first()[0] == 3
