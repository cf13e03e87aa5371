"""The training table's generated code stays short enough to be compiled, and trips are told from the ends of their pieces."""

import random

from pyspark.sql import functions as F

from fleetlens.operators import features as fx
from fleetlens.operators.trips import segment_trips

HUGE_METHOD = 8000  # bytes; the JVM interprets longer methods


def longest_method(spark, df):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(df._jdf.queryExecution().executedPlan())
        return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_pairs_are_compiled(spark):
    hit = "struct<at:double,tie:bigint>"
    features = spark.createDataFrame(
        [],
        "vehicle_id string, trip_no long, pos long, n_pos long, along_m double, ts long, shape_id string, seg_idx int, dist_along_norm double, speed double, "
        "hour_sin double, hour_cos double, dow int, time_since_start double, ts_age_s double, day string, line string, "
        "prev struct<neg_seq:bigint,seq:bigint,prev_vehicle:string,prev_trip_no:bigint,first_ts:bigint>, "
        f"passages map<bigint,struct<below:{hit},above:{hit}>>",
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert longest_method(spark, fx.eta_rows(features, arrays=False)) <= HUGE_METHOD
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows_of_trips(seed):
    draw, rows, event = random.Random(seed), [], 0
    for vehicle in ("a", "b", None):
        ts = 0
        for _ in range(300):
            ts += draw.choice([10, 30, 200, 500, 601, 700, 4000]) if draw.random() < 0.3 else 30
            event += 1
            rows.append((vehicle, event, ts, draw.choice(["r", "s"]), 1 if draw.random() < 0.03 else 0, "d", draw.choice(["08", "08", "08", None]) if draw.random() < 0.05 else "08"))
    return rows


def plain_trips(rows):
    """(event, trip, number in the trip, points, start, first route) by walking each vehicle's points."""
    out = []
    for vehicle in ("a", "b"):
        mine, trips = sorted((r for r in rows if r[0] == vehicle), key=lambda r: (r[2], r[1])), []
        for i, r in enumerate(mine):
            if i == 0 or r[2] - mine[i - 1][2] > 600 or r[4:] != mine[i - 1][4:]:
                trips.append([])
            trips[-1].append(r)
        for no, trip in enumerate(trips):
            if len(trip) >= 5:
                out += [(r[1], no, k, len(trip), trip[0][2], trip[0][3], trip[0][4]) for k, r in enumerate(trip)]
    return sorted(out)


def test_trips_like_a_plain_walk(spark):
    rows = rows_of_trips(3)
    obs = spark.createDataFrame(rows, "vehicle_id string, event_id long, ts long, route_id string, direction_id int, start_date string, start_time string")
    for bucket_s in (100, 3600):
        got = segment_trips(obs, bucket_s=bucket_s).select("event_id", "trip_no", "point_no", "n_points", "trip_start_ts", "trip_route_id", "trip_direction_id")
        assert sorted(map(tuple, got.collect())) == plain_trips(rows)
    plan = segment_trips(obs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert segment_trips(obs.where(F.lit(False))).count() == 0
