"""The splittable building blocks against straightforward computations."""

import bisect
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import scale

RNG = random.Random(3)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows."""
    rows = [("hot" if RNG.random() < 0.7 else f"k{RNG.randrange(20)}", RNG.randrange(40_000), i, RNG.gauss(50, 40)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, ts long, id long, x double").repartition(13)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_number_rows_is_dense_over_buckets(skewed):
    rows, df = skewed
    got = scale.number_rows(df.withColumn("b", scale.bucket(F.col("ts"), 3600)), ["k"], "b", ["ts", "id"], "pos")
    want = {r[2]: i for g in by_key(rows).values() for i, r in enumerate(g)}
    assert {r["id"]: r["pos"] for r in got.collect()} == want


def test_with_previous_crosses_buckets(skewed):
    rows, df = skewed
    got = scale.with_previous(df.withColumn("b", scale.bucket(F.col("ts"), 500)), ["k"], "b", ["ts", "id"], ["id"], "prev")
    want = {}
    for g in by_key(rows).values():
        want.update({r[2]: (g[i - 1][2] if i else None) for i, r in enumerate(g)})
    assert {r["id"]: (r["prev"]["id"] if r["prev"] else None) for r in got.collect()} == want


def test_running_total(skewed):
    rows, df = skewed
    got = scale.running_total(df.withColumn("b", scale.bucket(F.col("ts"), 900)), ["k"], "b", ["ts", "id"], "id", "s")
    want = {}
    for g in by_key(rows).values():
        total = 0
        for r in g:
            total += r[2]
            want[r[2]] = total
    assert {r["id"]: r["s"] for r in got.collect()} == want


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_exact_quantiles_match_numpy(skewed, width):
    rows, df = skewed
    probs = {"p2": 0.02, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in scale.exact_quantiles(df, ["k"], "x", probs, width=width).collect()}
    for k, g in by_key(rows).items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.percentile([r[3] for r in g], p * 100))


def test_index_quantiles(skewed):
    rows, df = skewed
    got = scale.exact_quantiles(df, [], "x", {"a": 0.5, "b": 0.99}, method="index").first()
    xs = sorted(r[3] for r in rows)
    assert (got["a"], got["b"]) == (xs[int(len(xs) * 0.5)], xs[int(len(xs) * 0.99)])


def test_quantiles_by_day_equal_recomputation(skewed, spark):
    rows, df = skewed
    daily = df.withColumn("d", (F.col("ts") % 6).cast("int"))
    got = {(r["k"], r["d"]): r["m"] for r in scale.exact_quantiles_by_day(daily, ["k"], "d", "x", {"m": 0.3}, width=5.0).collect()}
    groups = by_key(rows)
    assert len(got) == len({(r[0], r[1] % 6) for r in rows})
    for (k, d), m in got.items():
        assert m == pytest.approx(np.percentile([r[3] for r in groups[k] if r[1] % 6 <= d], 30))


def test_bracketing_neighbours_match_bisect(spark):
    pts = [(k, RNG.randrange(0, 4000) / 4, RNG.randrange(100)) for k in ("a", "b") for _ in range(150)]
    qs = [(k, RNG.randrange(-200, 4400) / 4, i) for i, k in enumerate(["a", "b", "c"] * 60)]
    p = spark.createDataFrame(pts, "k string, at double, t long")
    q = spark.createDataFrame(qs, "k string, at double, qid long")
    got = {r["qid"]: r for r in scale.bracketing_neighbours(q, p, ["k"], "at", "t", 100.0).collect()}
    for k, x, i in qs:
        track = sorted((a, t) for kk, a, t in pts if kk == k)
        j = bisect.bisect_left([a for a, _ in track], x)
        below = track[j - 1] if j > 0 else None
        above = track[j] if j < len(track) else None
        assert (tuple(got[i]["below"]) if got[i]["below"] else None) == below
        assert (tuple(got[i]["above"]) if got[i]["above"] else None) == above


def test_value_key_orders_like_the_bits(spark):
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, 1.0 - 2.0**-53, 1.0 + 2.0**-52, 1.7976931348623157e308, float("inf"), -float("inf")]
    xs += [2.0**e * f for e in range(-1040, 1023, 7) for f in (1.0, 1 - 2.0**-53, 1 + 2.0**-52)] + [RNG.gauss(0, 1) * 10.0 ** RNG.randrange(-300, 300) for _ in range(3000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scale.value_key(F.col("x")).alias("k")).collect()
    bits = lambda x: struct.unpack("<q", struct.pack("<d", abs(x)))[0] * (-1 if x < 0 else 1)
    assert [(r["x"], r["k"]) for r in got] == [(x, bits(x)) for x in xs]


@pytest.mark.parametrize("spread", ["dense", "beyond", "huge"])
def test_quantiles_of_buckets_too_large_to_order(spark, monkeypatch, spread):
    """Nine tenths of a hot key's values lie in one histogram bucket or past its ends."""
    monkeypatch.setattr(scale, "SORTED_VALUES", 1)
    far = {"dense": lambda: RNG.random() / 1e6, "beyond": lambda: 1e9 + RNG.gauss(0, 1e5), "huge": lambda: -(10.0 ** RNG.randrange(10, 300)) * RNG.random()}[spread]
    rows = [("hot", far() if RNG.random() < 0.9 else RNG.gauss(0, 100)) for _ in range(4000)] + [("cold", float(i)) for i in range(7)] + [("hot", 3.5)] * 300
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    probs = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    for narrow in (True, False):
        got = {r["k"]: r for r in scale.exact_quantiles(df, ["k"], "x", probs, width=100.0, narrow=narrow).collect()}
        for k in ("hot", "cold"):
            xs = [x for key, x in rows if key == k]
            assert [got[k][n] for n in probs] == pytest.approx([np.quantile(xs, p) for p in probs.values()], rel=1e-12)
    days = df.withColumn("d", (F.abs(F.hash("x")) % 4).cast("int"))
    seen = [(r["k"], r["d"], r["x"]) for r in days.collect()]
    for r in scale.exact_quantiles_by_day(days, ["k"], "d", "x", {"m": 0.7}).collect():
        assert r["m"] == pytest.approx(np.quantile([x for k, d, x in seen if k == r["k"] and d <= r["d"]], 0.7), rel=1e-12)
