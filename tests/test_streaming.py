"""State across micro-batches: slices anywhere, repeated batches, vehicles that leave."""

import itertools

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import capture
from fleetlens.schemas import VEHICLE
from fleetlens.streaming import live

FRAME = f"frame_no long, t long, part int, keyframe boolean, gap boolean, new array<{VEHICLE.simpleString()}>, del array<string>, upd array<{VEHICLE.simpleString()}>"


def vehicle(id_, ts, **known):
    return {f.name: known.get(f.name) for f in VEHICLE.fields} | {"id": id_, "ts": ts}


def frames():
    """Twelve frames a minute apart, keyframes at 0 and 8; vehicle c joins at 3 and leaves at 6, b stands still."""
    out = []
    for n in range(12):
        t = 1000 + 60 * n
        every = [vehicle("a", t, lat=float(n), label="x-39"), vehicle("b", 1000, lat=1.0, label="y-39")]
        if n in (0, 8):
            out.append((n, t, 0, True, False, every, [], []))
        else:
            new = [vehicle("c", t, lat=5.0, label="z-26")] if n == 3 else []
            out.append((n, t, 0, False, False, new, ["c"] if n == 6 else [], [vehicle("a", t, lat=float(n))]))
    return out


def stepwise(spark, tmp_path, rows, edges, repeat=()):
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    for k, (low, high) in enumerate(itertools.pairwise([0, *edges, 99])):
        batch = spark.createDataFrame([r for r in rows if low <= r[0] < high], FRAME).coalesce(1).persist()
        for _ in range(2 if k in repeat else 1):
            live.replay_batch(batch, k, out, state, 100)
    return sorted(tuple(r) for r in spark.read.parquet(out).select("vehicle_id", "ts", "frame_ts", "lat", "label").collect())


def whole(spark, rows):
    got = capture.observations(capture.replay(spark.createDataFrame(rows, FRAME), 100))
    return sorted(tuple(r) for r in got.select("vehicle_id", "ts", "frame_ts", "lat", "label").collect())


@pytest.mark.parametrize("edges, repeat", [([4, 7], (0, 1)), ([8, 8, 9], (2,))])
def test_slices_anywhere_give_the_whole(spark, tmp_path, edges, repeat):
    rows = frames()
    want = whole(spark, rows)
    assert stepwise(spark, tmp_path, rows, edges, repeat) == want
    assert ("c", 1180, 1240, 5.0, "z-26") in want and sum(r[0] == "b" for r in want) == 1


def test_old_versions_go(spark, tmp_path):
    stepwise(spark, tmp_path, frames(), [4, 9])
    for name in ("fleet", "clock", "seen"):
        assert live.Versions(f"{tmp_path}/state/{name}").numbers(spark) == [1, 2]
    fleet = live.newest_version(spark, f"{tmp_path}/state/fleet")
    assert sorted(r["id"] for r in fleet.collect()) == ["a", "b"]


def test_lost_state_raises(spark, tmp_path):
    batch = spark.createDataFrame(frames()[4:], FRAME)
    with pytest.raises(Exception, match="(?i)path"):
        live.replay_batch(batch, 1, f"{tmp_path}/out", f"{tmp_path}/state", 100)


def test_vehicles_leave_with_the_next_cycle(spark, tmp_path):
    state = live.Versions(f"{tmp_path}/fleet")
    cycle = lambda t, *ids: [(i, t, t - 5, "v") for i in ids]
    batches = [cycle(10, "a", "b") + cycle(20, "a", "b", "c"), cycle(30, "b"), cycle(25, "a", "c"), [], cycle(30, "d")]
    seen = []
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "vehicle_id string, frame_ts long, ts long, label string")
        for _ in range(2):  # a repeated batch changes nothing
            fleet = live.refresh_fleet(batch, k, state, ["ts"])
        seen.append(sorted(r["vehicle_id"] for r in fleet.collect()))
    assert seen == [["a", "b", "c"], ["b"], ["b"], ["b"], ["b", "d"]]


def payloads(plan, node):
    return [line for line in plan.splitlines() if node in line and any(f"{c}#" in line for c in ("new", "del", "upd"))]


def test_frames_are_neither_ordered_nor_moved(spark, tmp_path):
    """What a frame carries meets its interval where it lies."""
    spark.createDataFrame(frames(), FRAME).write.parquet(f"{tmp_path}/frames")
    df = capture.replay(spark.read.parquet(f"{tmp_path}/frames"), 100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("Window ", "Exchange ", "Sort "):
        assert not payloads(plan, node)
    assert df.where(F.col("id") == "c").count() == 1
