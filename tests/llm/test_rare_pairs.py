"""Open buckets: members are compared where they share a rare element, and no link is lost."""

import random

from pyspark.sql import functions as F

from fleetlens.llm.linking import link
from fleetlens.llm.workspace import Workspace


def test_open_bucket_of_a_template(llm):
    """300 sets with half their elements in common, none linked but for 20 planted pairs, all in one bucket."""
    draw, common = random.Random(5), list(range(30))
    sets = {k: common + [1000 + 100 * k + i for i in range(30)] for k in range(300)}
    for k in range(0, 40, 2):  # from 0.79 to 0.83
        sets[k + 1] = sets[k][: 53 + k % 3] + [-100 * k - i - 1 for i in range(7 - k % 3)]
    sets = {k: draw.sample(s, len(s)) for k, s in sets.items()}
    rows = llm.createDataFrame([(k, s) for k, s in sets.items()], "id long, body array<long>")
    compared = []

    def verify(pairs):
        both = pairs.select("a", "b", F.size(F.array_intersect("a_body", "b_body")).cast("long").alias("common"), (F.size("a_body") + F.size("b_body")).cast("long").alias("both"))
        compared.append(both.count())
        return both

    buckets = rows.select(F.lit(7).cast("long").alias("key"), "id", F.size("body").alias("n"))
    got = link(buckets, lambda ids: rows.join(ids, "id", "left_semi"), verify, Workspace(llm, "rare"), elements=lambda body: body)
    got = {r["id"]: r["component"] for r in got.collect()}
    wanted = {}
    for a in range(300):
        for b in range(a + 1, 300):
            x, y = set(sets[a]), set(sets[b])
            if 100 * len(x & y) >= 80 * len(x | y):
                wanted |= {a: a, b: a}
    assert len(wanted) > 10 and got == wanted
    assert compared[0] == 299 and compared[1] < 100
