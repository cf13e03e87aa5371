"""Recordings: files, replay semantics, encoding round trip, streaming state."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import capture as cp
from fleetlens.sources import frames as fr

T0 = 1_699_963_200  # 2023-11-14 12:00 UTC


def car(i, lat=-34.6, ts=T0, **kw):
    base = {
        "id": i, "label": f"{i}-39", "license_plate": "AA000AA", "route_id": "1", "trip_id": "t", "direction_id": 0, "start_date": "20231114",
        "start_time": "08:00:00", "lat": lat, "lon": -58.4, "speed": 5.0, "odo": 0, "stop_id": "", "seq": 0, "status": 0, "ts": ts,
    }
    return {**base, **kw}


def write(folder, name, lines):
    with gzip.open(folder / name, "wt") as f:
        for line in lines:
            f.write((line if isinstance(line, str) else json.dumps(line)) + "\n")


def recording():
    key = lambda t, *cars: {"t": t, "keyframe": True, "new": list(cars), "del": [], "upd": []}
    delta = lambda t, new=(), gone=(), upd=(): {"t": t, "new": list(new), "del": list(gone), "upd": list(upd)}
    return [
        key(T0, car("a"), car("b"), car("c")),
        delta(T0 + 30, upd=[{"id": "a", "ts": T0 + 30, "lat": -34.5}, {"id": "zz", "ts": T0 + 30, "lat": 0.0}]),
        "not json {",
        "",
        delta(T0 + 60, gone=["b"], new=[car("d", ts=T0 + 60)]),
        {"t": T0 + 760, "gap": True, "gap_seconds": 700, "reason": "restart"},
        key(T0 + 760, car("a", ts=T0 + 760)),
        delta(T0 + 790, upd=[{"id": "c", "ts": T0 + 790, "lat": 1.0}, {"id": "a", "ts": T0 + 790, "speed": 9.0}]),
    ]


@pytest.fixture()
def frames(spark, tmp_path):
    write(tmp_path, "2023-11-14.ndjson.gz", recording())
    write(tmp_path, "notes.md", ["noise"])
    return fr.read_frames(spark, str(tmp_path))


def test_broken_and_blank_lines_are_skipped_in_order(frames):
    rows = frames.orderBy("frame_no").collect()
    assert [r["t"] - T0 for r in rows] == [0, 30, 60, 760, 760, 790]
    assert [bool(r["gap"]) for r in rows] == [False, False, False, True, False, False]


def state(frames, interval=0, **kw):
    out = {}
    for r in cp.replay(frames, interval, **kw).collect():
        out.setdefault(r["frame_ts"] - T0, {})[r["id"]] = (r["lat"], r["speed"], r["ts"] - T0)
    return out


def test_replay_semantics(frames):
    got = state(frames)
    assert set(got) == {0, 30, 60, 760, 790}
    assert set(got[0]) == {"a", "b", "c"}
    assert got[30]["a"] == (-34.5, 5.0, 30) and "zz" not in got[30]
    assert set(got[60]) == {"a", "c", "d"} and got[60]["a"] == (-34.5, 5.0, 30)
    assert set(got[760]) == {"a"} and got[790] == {"a": (-34.6, 9.0, 790)}


def test_sampling_keeps_keyframes_and_interval(frames):
    assert set(state(frames, interval=60)) == {0, 60, 760}


def test_line_filter(spark, tmp_path):
    lines = recording()
    lines[4]["new"].append(car("a", label="a-42"))
    write(tmp_path, "2023-11-14.ndjson.gz", lines)
    m = spark.createDataFrame([("39", "39", ""), ("42", "42", "")], "suffix string, line string, agency string")
    got = state(fr.read_frames(spark, str(tmp_path)), label_map=m, lines=["39"])
    assert set(got[30]) == {"a", "b", "c"} and set(got[60]) == {"c", "d"} and set(got[760]) == {"a"}


def test_days_are_selected_in_order(spark, tmp_path):
    for d in ("2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02"):
        write(tmp_path, f"{d}.ndjson.gz", recording())
    f = fr.read_frames(spark, str(tmp_path))
    kept = fr.select_days(f, skip_first=1, max_days=2, exclude="2024-02-28")
    assert [r["day"] for r in kept.select("day").distinct().orderBy("day").collect()] == ["2024-02-29", "2024-03-01"]
    assert fr.count_days(f).first()["n_days"] == 5
    with pytest.raises(ValueError):
        fr.require_days(f, 90)


@pytest.mark.parametrize("per_line, every", [(20_000, 100), (3, 4)])
def test_replay_inverts_encoding(spark, per_line, every):
    rng = random.Random(11)
    rows = []
    for cycle in range(12):
        for v in range(9):
            if rng.random() < 0.75:
                rows.append((T0 + 30 * cycle, f"v{v}", rng.choice([1.0, 2.0]), rng.choice([0, 1]), T0 + 30 * cycle))
    snaps = spark.createDataFrame(rows, "frame_ts long, id string, lat double, direction_id int, ts long")
    cycles = cp.mark_keyframes(cp.number_cycles(snaps), every=every)
    frames = cp.recording(cp.encode_deltas(snaps, cycles, changes_per_line=per_line), cp.gap_records(cycles))
    got = {(r["frame_ts"], r["id"]): (r["lat"], r["direction_id"]) for r in cp.replay(frames, 0).collect()}
    tops = {f: max(r[4] for r in rows if r[0] == f) for f, *_ in rows}
    assert got == {(tops[r[0]], r[1]): (r[2], r[3]) for r in rows}


def test_recording_is_not_gathered_to_be_numbered(spark):
    """Gaps come right before their frame, parts share a number, and the lines lie in several partitions."""
    rows = [(T0 + 30 * c + (900 if c > 5 else 0), f"v{v}", float(c), T0 + 30 * c) for c in range(12) for v in range(9)]
    snaps = spark.createDataFrame(rows, "frame_ts long, id string, lat double, ts long")
    cycles = cp.mark_keyframes(cp.number_cycles(snaps), every=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frames = cp.recording(cp.encode_deltas(snaps, cycles, changes_per_line=3), cp.gap_records(cycles))
        got = frames.select("cycle_no", "part", F.coalesce("gap", F.lit(False)).alias("gap"), "frame_no", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r["frame_no"] for r in got if r["gap"]} == {6}
    assert {(r["cycle_no"], r["frame_no"]) for r in got if not r["gap"]} == {(c, c + (c > 5)) for c in range(12)}
    assert max(r["part"] for r in got) > 1 and len({r["p"] for r in got}) > 1


def test_unchanged_vehicle_emits_nothing(spark):
    rows = [(T0 + 30 * c, "a", 1.0, T0 + 30 * c) for c in range(3)]
    snaps = spark.createDataFrame(rows, "frame_ts long, id string, lat double, ts long")
    changes = cp.change_rows(snaps, cp.mark_keyframes(cp.number_cycles(snaps)))
    assert [(r["cycle_no"], r["op"]) for r in changes.collect()] == [(0, "new")]


def test_gap_forces_keyframe(spark):
    cycles = spark.createDataFrame([(T0, 0), (T0 + 30, 1), (T0 + 900, 2), (T0 + 1500, 3)], "frame_ts long, cycle_no long")
    marked = cp.mark_keyframes(cycles)
    assert [r["keyframe"] for r in marked.orderBy("cycle_no").collect()] == [True, False, True, False]
    assert [(r["t"], r["gap_seconds"]) for r in cp.gap_records(marked).collect()] == [(T0 + 900, 870)]


def test_written_frames_read_back(spark, tmp_path):
    write(tmp_path, "2023-11-14.ndjson.gz", recording())
    first = fr.read_frames(spark, str(tmp_path))
    fr.write_frames(first.drop("day", "file"), str(tmp_path / "out"))
    again = fr.read_frames(spark, str(tmp_path / "out"))
    key = lambda df: [(r["frame_no"], r["t"], r["gap"], r["keyframe"], r["n"]) for r in df.select("*", F.size("new").alias("n")).orderBy("frame_no").collect()]
    assert key(first) == key(again)


def test_state_crosses_files_unless_told_otherwise(spark, tmp_path):
    lines = recording()
    write(tmp_path, "2023-11-14.ndjson.gz", lines[:2])
    write(tmp_path, "2023-11-15.ndjson.gz", [{"t": T0 + 90, "new": [], "del": [], "upd": [{"id": "a", "ts": T0 + 90, "lat": 7.0}]}, *lines[6:]])
    frames = fr.read_frames(spark, str(tmp_path))
    assert set(state(frames)[90]) == {"a", "b", "c"} and state(frames)[90]["a"] == (7.0, 5.0, 90)
    alone = state(frames, per_file=True)
    assert 90 not in alone and set(alone[760]) == {"a"}
