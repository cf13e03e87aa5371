"""Segmentation, projection, pairs and lookup on hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions import geo
from fleetlens.operators import eta_models as em
from fleetlens.operators import features as fx
from fleetlens.operators import filters, geometry
from fleetlens.operators.trips import segment_trips

OBS = "vehicle_id string, event_id long, ts long, direction_id int, route_id string, start_date string, start_time string"


def obs(spark, stamps, directions=None, times=None):
    n = len(stamps)
    rows = [("v", i, t, (directions or [0] * n)[i], "r", "20231114", (times or ["08:00:00"] * n)[i]) for i, t in enumerate(stamps)]
    return spark.createDataFrame(rows, OBS)


def n_trips(df):
    return df.select("trip_no").distinct().count()


BASE = 1_699_963_200  # 2023-11-14 12:00 UTC


def steps(*gaps):
    """Times from BASE on with these gaps between them."""
    return [BASE + sum(gaps[:k]) for k in range(len(gaps) + 1)]


@pytest.mark.parametrize(
    "stamps, directions, times, want",
    [
        (steps(*[45] * 3), None, None, 0),  # one point under the least
        (steps(*[45] * 4), None, None, 1),
        (steps(*[45] * 5, 599, *[45] * 6), None, None, 1),  # around the longest gap within a trip
        (steps(*[45] * 5, 600, *[45] * 6), None, None, 1),
        (steps(*[45] * 5, 601, *[45] * 6), None, None, 2),
        (steps(*[45] * 5, 601, *[45] * 3), None, None, 1),  # what follows is too short
        (steps(*[45] * 12), [1] * 6 + [0] * 7, None, 2),
        (steps(*[45] * 12), [1] * 12 + [0], None, 1),  # the change leaves a single point
        (steps(*[45] * 12), [1] + [0] * 12, None, 1),
        (steps(*[45] * 12), None, ["06:15:00"] * 7 + ["07:40:00"] * 6, 2),
    ],
)
def test_cuts(spark, stamps, directions, times, want):
    assert n_trips(segment_trips(obs(spark, stamps, directions, times))) == want


@pytest.mark.parametrize("bucket_s", [60, 600, 3600, 10**9])
def test_segmentation_does_not_depend_on_bucket_or_partitions(spark, bucket_s):
    rng = random.Random(5)
    t, stamps = BASE, []
    for _ in range(400):
        t += rng.choice([20, 30, 60, 300, 599, 601, 1500])
        stamps.append(t)
    df = obs(spark, stamps, [int(rng.random() < 0.03) for _ in stamps])
    cols = ["event_id", "trip_no", "point_no", "n_points", "trip_start_ts"]
    ref = sorted(map(tuple, segment_trips(df.coalesce(1), bucket_s=10**10).select(*cols).collect()))
    assert sorted(map(tuple, segment_trips(df.repartition(11), bucket_s=bucket_s).select(*cols).collect())) == ref


def shape_df(spark, points, line="39", shape="s", direction=0):
    return spark.createDataFrame(
        [(line, "c", 0, shape, "39A", "n", direction, points, [])],
        "line string, color string, branch_pos int, shape_id string, short_name string, name string, direction int, "
        "points array<struct<lat:double,lon:double>>, stops array<struct<id:string,name:string,lat:double,lng:double>>",
    )


def brute_project(points, lat, lon):
    best, cum = None, 0.0
    for (a0, a1), (b0, b1) in zip(points, points[1:]):
        m = geo.METRES_PER_DEGREE * math.cos(math.radians((a0 + b0) / 2))
        y, x = (b0 - a0) * geo.METRES_PER_DEGREE, (b1 - a1) * m
        length = math.hypot(x, y)
        py, px = (lat - a0) * geo.METRES_PER_DEGREE, (lon - a1) * m
        t = min(max((px * x + py * y) / (length * length), 0), 1) if length * length > 1e-9 else 0.0
        err = math.hypot(px - t * x, py - t * y)
        if best is None or err < best[0]:
            best = (err, cum + t * length)
        cum += length
    return best


def test_projection_matches_brute_force(spark):
    rng = random.Random(9)
    pts = [(-34.6 + rng.random() / 50, -58.4 + i / 300) for i in range(15)]
    pts.insert(5, pts[4])
    pings = [(i, -34.6 + rng.random() / 40, -58.41 + rng.random() / 15) for i in range(60)]
    paths = geometry.prepared_paths(shape_df(spark, pts))
    df = spark.createDataFrame(pings, "id long, lat double, lon double").withColumn("shape_id", F.lit("s"))
    for row in geometry.project_points(df, paths, ["shape_id"]).collect():
        err, along = brute_project(pts, row["lat"], row["lon"])
        assert row["offset_m"] == pytest.approx(err, abs=1e-6) and row["along_m"] == pytest.approx(along, abs=1e-6)


def test_single_vertex_shape(spark):
    paths = geometry.prepared_paths(shape_df(spark, [(-34.6, -58.4)]))
    df = spark.createDataFrame([("s", -34.601, -58.4)], "shape_id string, lat double, lon double")
    row = geometry.project_points(df, paths, ["shape_id"]).first()
    assert row["along_m"] == 0 and row["offset_m"] == pytest.approx(111.32, abs=0.01)


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine_m(F.lit(-34.6), F.lit(-58.4), F.lit(-34.6), F.lit(-58.4)).alias("z"), geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d")).first()
    assert d["z"] == 0 and d["d"] == pytest.approx(111_194.93, abs=0.1)


def test_time_encoding_at_noon(spark):
    noon = 1_699_974_000  # 2023-11-14 12:00 in Buenos Aires, a Tuesday
    row = fx.encode_time(spark.createDataFrame([(noon,)], "ts long")).first()
    assert row["hour_sin"] == pytest.approx(0, abs=1e-9) and row["hour_cos"] == pytest.approx(-1) and row["dow"] == 1


def test_segment_index(spark):
    got = spark.createDataFrame([(0.5,), (999.5,), (1000.0,), (2750.0,)], "d double").select(fx.segment_index(F.col("d")).alias("s")).collect()
    assert [r["s"] for r in got] == [0, 1, 2, 5]


@pytest.mark.parametrize("block", [3, 7, 512])
def test_blocked_pairs_match_brute_force(spark, block):
    rng = random.Random(1)
    rows, want = [], set()
    for trip in range(3):
        n = 25
        pts = [(("v", trip, i, rng.uniform(0, 3000), 100 + 30 * (i // 2), n)) for i in range(n)]
        rows += pts
        want |= {(trip, p[2], f[2]) for p in pts for f in pts if f[2] > p[2] and f[3] - p[3] >= 100 and f[4] > p[4]}
    df = spark.createDataFrame(rows, "vehicle_id string, trip_no int, pos long, along_m double, ts long, n_pos int")
    got = fx.future_pairs(df, [], [], block=block)
    found = [(r["trip_no"], r["pos"], r["f_pos"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_interp_passage_cases(spark):
    cases = [
        ((900.0, 100), (1100.0, 200), 1000.0, 500, 350.0, True),
        ((900.0, 100), (1100.0, 900), 1000.0, 300, 200.0, True),  # passage later than now, ping below counts
        ((500.0, 100), (1100.0, 200), 1000.0, 110, 3600.0, False),
        (None, (1100.0, 50), 1000.0, 100, 50.0, True),
        ((700.0, 50), None, 1000.0, 100, 3600.0, False),
        ((900.0, 0), (1000.0, 10), 1000.0, 9000, 3600.0, True),
    ]
    rows = [(i, b, a, d, t) for i, (b, a, d, t, _, _) in enumerate(cases)]
    pt = "struct<at:double,tie:long>"
    df = spark.createDataFrame(rows, f"i int, below {pt}, above {pt}, d double, t long")
    got = df.select("i", fx.interp_passage(F.col("below"), F.col("above"), F.col("d"), F.col("t")).alias("x")).orderBy("i").collect()
    for row, (*_, seconds, found) in zip(got, cases):
        assert (row["x"]["seconds"], row["x"]["found"]) == (pytest.approx(seconds), found)


TRAIN = "ramal_id string, seg_idx int, hour_sin double, hour_cos double, dow int, dist_remaining_m double, observed_eta_s double"


def train(spark):
    angle = 2 * math.pi * 8 / 24
    rows = [("b", s, math.sin(angle), math.cos(angle), 1, 600.0, 100.0 if s == 0 else 200.0) for s in (0, 1)]
    return spark.createDataFrame(rows, TRAIN)


def ask(spark, lookup, rows):
    df = spark.createDataFrame(rows, "i int, ramal_id string, from_m double, to_m double, hour int, dow int")
    return {r["i"]: (r["eta_s"], r["confidence"]) for r in em.predict_eta(df, lookup).collect()}


def test_eta_walk_and_fallbacks(spark):
    lookup = em.fit_speed_lookup(train(spark))
    got = ask(
        spark,
        lookup,
        [
            (0, "b", 0.0, 1000.0, 8, 1),
            (1, "b", 0.0, 1600.0, 8, 1),
            (2, "b", 0.0, 500.0, 8, 3),
            (3, "b", 0.0, 500.0, 20, 3),
            (4, "x", 0.0, 700.0, 8, 1),
            (5, "b", 500.0, 500.0, 8, 1),
            (6, "b", 900.0, 100.0, 8, 1),
            (7, "x", 0.0, 1e6, 8, 1),
        ],
    )
    assert got[0] == (pytest.approx(500 / 6 + 500 / 3), "high")
    assert got[1] == (pytest.approx(500 / 6 + 500 / 3 + 600 / 4.5), "medium")
    assert got[2] == (pytest.approx(500 / 4.5), "medium")
    assert got[3] == (pytest.approx(500 / 4.5), "low")
    assert got[4] == (pytest.approx(100.0), "low")
    assert got[5] == (0.0, "high") and got[6] == (0.0, "high") and got[7] == (7200.0, "low")


def test_lookup_round_trip(spark, tmp_path):
    lookup = em.fit_speed_lookup(train(spark))
    em.save_lookup(lookup, str(tmp_path / "l"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(em.load_lookup(spark, str(tmp_path / "l")).select(*lookup.columns)) == key(lookup)


def test_requests_are_checked(spark):
    rows = [(1, 0.0, -58.4, "39", 300.0, 3), (2, -34.6, -58.4, "39", 5000.0, 3), (3, -34.6, -58.4, None, None, None), (4, -34.6, -58.4, "ab", 300.0, 3), (5, -34.6, -58.4, "39", 300.0, 11)]
    df = spark.createDataFrame(rows, "request_id int, lat double, lon double, line string, radius_m double, max_results int")
    got = {r["request_id"]: r["reason"] for r in filters.validate_requests(df).collect()}
    assert got == {1: "lat", 2: "radius_m", 3: None, 4: "line", 5: "max_results"}


def test_profile_counts_bad_numbers(spark):
    xs = [1.0, 2.0, 3.0, float("nan"), float("inf"), 10.0]
    row = fx.profile(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"]).first()
    assert (row["n"], row["n_nan"], row["n_inf"], row["min"], row["max"]) == (6, 1, 1, 1.0, 10.0)
    assert row["p99"] == pytest.approx(np.percentile([1, 2, 3, 10], 99))
    two = spark.createDataFrame([(x, -x) for x in xs] + [(None, 40.0)], "x double, y double")
    got = {r["name"]: r for r in fx.profile(two, ["x", "y"], ranges={"x": (2.0, 9.0)}, scales={"y": 10.0}).collect()}
    assert [(got[c]["n"], got[c]["n_valid"], got[c]["n_outside"], got[c]["max_abs"]) for c in "xy"] == [(7, 4, 2, 10.0), (7, 5, 0, 4.0)]


def test_grid_projection_equals_full_projection(spark):
    rng = random.Random(21)
    pts = [(-34.6 + rng.random() / 30, -58.4 + i / 250) for i in range(25)]
    pings = [(i, -34.61 + rng.random() / 20, -58.42 + rng.random() / 8) for i in range(1500)]
    paths = geometry.prepared_paths(shape_df(spark, pts))
    df = spark.createDataFrame(pings, "id long, lat double, lon double").withColumn("shape_id", F.lit("s"))
    key = lambda d: sorted((r["id"], round(r["along_m"], 6), round(r["offset_m"], 6)) for r in d.collect())
    full = key(geometry.near_path(geometry.project_points(df, paths, ["shape_id"])))
    assert full and key(geometry.project_near(df, paths, ["shape_id"])) == full
