import random

from fleetlens.llm.linking import components, link
from fleetlens.llm.workspace import Workspace


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def found(df):
    rows = df.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["component"] for r in rows}


def test_components_of_paths_stars_and_random_graphs(llm):
    rnd = random.Random(3)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(5000, i) for i in range(200, 260)]
    loose = [(rnd.randrange(1000, 1300), rnd.randrange(1000, 1300)) for _ in range(160)]
    pairs = [p for p in path + star + loose if p[0] != p[1]]
    edges = llm.createDataFrame(pairs + [(7, 7), (None, 3)], "a long, b long")
    assert found(components(edges, Workspace(llm, "t"))) == roots(pairs)


def test_no_edges(llm):
    assert found(components(llm.createDataFrame([], "a long, b long"), Workspace(llm, "t"))) == {}


def test_links_between_members_that_their_leader_does_not_hold(llm):
    """One bucket: 0 is unlike all others; 1-2 and 3-4-5 are alike; 6 is alone."""
    base = list(range(100))
    sets = {0: list(range(1000, 1100)), 1: base, 2: base[:90], 3: base[:60] + list(range(200, 240)), 4: base[:60] + list(range(200, 236)), 5: base[:56] + list(range(200, 236)), 6: base[:50] + list(range(300, 350))}
    grams = llm.createDataFrame(list(sets.items()), "id long, body array<long>")
    buckets = llm.createDataFrame([(9, i) for i in sets], "key long, id long")
    want = roots([(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})])
    sizes = "size(array_intersect(a_body, b_body)) as common", "size(a_body) + size(b_body) as both"
    for block in (256, 2):
        got = found(link(buckets, lambda ids: grams.join(ids, "id", "left_semi"), lambda p: p.selectExpr("a", "b", *sizes), Workspace(llm, "t"), block=block))
        assert got == want and want == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
