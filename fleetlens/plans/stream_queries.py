"""Streams over files of pings, run to completion with available-now triggers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fleetlens.operators.filters import resolve_line, valid_requests, validate_requests
from fleetlens.plans import arrival_queries  # noqa: F401  (its statements are used again below)
from fleetlens.plans import testbed as tb
from fleetlens.plans.capture_queries import CYCLE_S, EVERY, INTERVAL, PAUSE_S, recording, snap_table
from fleetlens.plans.model_queries import lookup
from fleetlens.plans.oracle import CTES, cte, sql
from fleetlens.plans.registry import query, r, rq
from fleetlens.plans.trip_queries import requests
from fleetlens.session import shared_dir
from fleetlens.streaming import live


def in_slices(spark, table, slices: list, start) -> None:
    """Append the slices to a folder one after the other; after each, the stream runs until it has read all there is.

    So every slice is a batch, whatever the number of its files.
    """
    path = shared_dir(spark, "stream-in")
    for cond in slices:
        table.where(cond).write.mode("append").parquet(path)
        q = start(spark.readStream.schema(table.schema).parquet(path))
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()


def dirs(spark, *names):
    return [shared_dir(spark, n) for n in names]


def cuts(c, edges) -> list:
    return [c < edges[0], (c >= edges[0]) & (c < edges[1]), c >= edges[1]]


def ping_slices(spark, sf, start):
    p = tb.lined_pings(spark, sf).select("vehicle_id", "event_id", "ts", "lat", "lon", "speed", "direction_id", "route_id", "label", "line")
    in_slices(spark, p, cuts(F.col("ts"), [17_049_000, 17_058_000]), start)


EDGES = [e + e // (31 * CYCLE_S) * PAUSE_S for e in (17_049_000, 17_058_000)]


def snap_slices(spark, sf, start):
    in_slices(spark, snap_table(spark, sf), cuts(F.col("frame_ts"), EDGES), start)


def feed_slices(spark, sf, start):
    """Cycles of the feed with the line of each vehicle."""
    snaps = resolve_line(snap_table(spark, sf).withColumnRenamed("id", "vehicle_id"), tb.label_map(spark))
    in_slices(spark, snaps.select("vehicle_id", "frame_ts", "ts", "lat", "lon", "speed", "direction_id", "route_id", "label", "line"), cuts(F.col("frame_ts"), EDGES), start)


# the cycle that is newest after each slice, and the vehicles it lists
cte(
    "newest_cycles",
    f"""select 0 as batch, max(frame_ts) as frame_ts from snap where frame_ts < {EDGES[0]} union all select 1, max(frame_ts) from snap where frame_ts < {EDGES[1]}
    union all select 2, max(frame_ts) from snap""",
    "snap",
)
cte("in_sight", "select n.batch, s.id as vehicle_id, m.line, s.* exclude (id) from newest_cycles n join snap s using (frame_ts) left join label_map m on split_part(s.label, '-', -1) = m.suffix", "newest_cycles", "snap", "label_map")
cte("fleet_now", "select *, row_number() over (order by vehicle_id) as event_id from in_sight where batch = 2", "in_sight")

# the board's statements once more, over the vehicles in sight
_BOARD = ["fleet_near", "candidates", "cand_steps", "cand_eta", "cand_rows", "board", "ranked_board"]
_NAMES = {"latest": "fleet_now"} | {n: f"{n}_now" for n in _BOARD}
for _n in _BOARD:
    _deps, _body = CTES[_n]
    cte(_NAMES[_n], re.sub(r"\b(" + "|".join(_NAMES) + r")\b", lambda m: _NAMES[m[1]], _body), *(_NAMES.get(d, d) for d in _deps))


@query("stream_deltas", sql("select cycle_no, op, id, case when op = 'upd' then changed end as changed from changes", "changes"))
def stream_deltas(spark, sf):
    out, state, chk = dirs(spark, "deltas", "deltas-state", "deltas-chk")
    snap_slices(spark, sf, lambda feed: live.stream_deltas(feed, out, state, chk, every=EVERY))
    rows = spark.read.parquet(out)
    return rows.select("cycle_no", "op", "id", F.when(F.col("op") == "upd", F.concat_ws(",", "changed")).alias("changed"))


@query("stream_gaps", sql("select frame_ts as t, since_s as gap_seconds from cyc where after_gap", "cyc"))
def stream_gaps(spark, sf):
    out, state, chk = dirs(spark, "gaps", "gaps-state", "gaps-chk")
    snap_slices(spark, sf, lambda feed: live.stream_gaps(feed, out, state, chk))
    return spark.read.parquet(out).select("t", "gap_seconds")


@query("stream_latest", sql(f"select batch, vehicle_id, frame_ts, ts, {rq('lat', None, 8)}, line from in_sight", "in_sight"))
def stream_latest(spark, sf):
    """The cache after each slice."""
    out, state, chk = dirs(spark, "latest", "latest-state", "latest-chk")
    feed_slices(spark, sf, lambda feed: live.stream_latest(feed, out, state, chk, ["ts"]))
    return spark.read.parquet(out).select("batch", "vehicle_id", "frame_ts", "ts", r("lat", 8).alias("lat"), "line")


cte(
    "recent",
    """select vehicle_id, event_id, ts from (select *, row_number() over (partition by vehicle_id order by ts desc, event_id desc) as rn, max(ts) over (partition by vehicle_id) as newest from lined) where rn <= 10 and ts >= newest - 3000""",
    "lined",
)


@query("stream_history", sql("select vehicle_id, event_id, ts from recent", "recent"))
def stream_history(spark, sf):
    state, chk = dirs(spark, "history", "history-chk")
    ping_slices(spark, sf, lambda pings: live.stream_history(pings, state, chk, window_s=3000))
    return live.newest_version(spark, state).select("vehicle_id", "event_id", "ts")


@query("stream_replay", sql("select id as vehicle_id, ts, min(frame_t) as frame_ts from replayed group by id, ts", "replayed"))
def stream_replay(spark, sf):
    """Slices cut inside keyframe intervals; a vehicle standing still is reported once."""
    frames = recording(spark, sf)
    plain = frames.where("not coalesce(keyframe, false) and not coalesce(gap, false) and part = 0").select("frame_no")
    edges = plain.agg(F.expr("percentile_approx(frame_no, array(0.34, 0.67))").alias("e")).first()["e"]
    out, state, chk = dirs(spark, "replayed", "replayed-state", "replayed-chk")
    in_slices(spark, frames, cuts(F.col("frame_no"), edges), lambda lines: live.stream_replay(lines, out, state, chk, INTERVAL))
    return spark.read.parquet(out).select("vehicle_id", "ts", "frame_ts")


@query("stream_arrivals", sql(f"select request_id, rank, line, vehicle_id, {rq('eta_s', None, 3)} from ranked_board_now", "ranked_board_now"))
def stream_arrivals(spark, sf):
    """The board after the last slice."""
    out, state, chk = dirs(spark, "board", "board-state", "board-chk")
    asked = tb.stored(valid_requests(validate_requests(requests(spark, sf))), "requests")
    known = (tb.shapes(spark), tb.paths(spark), lookup(spark, sf))
    feed_slices(spark, sf, lambda feed: live.stream_arrivals(feed, asked, *known, out, state, chk, now=tb.NOW))
    last = spark.read.parquet(out).where("batch = 2")
    return last.select("request_id", "rank", "line", "vehicle_id", r("eta_s", 3).alias("eta_s"))


TTL_S = 200


@query("stream_predictions", sql(f"select batch, vehicle_id, frame_ts, ts from in_sight where frame_ts - ts <= {TTL_S}", "in_sight"))
def stream_predictions(spark, sf):
    """What is in force after each slice."""
    out, state, chk = dirs(spark, "predictions", "predictions-state", "predictions-chk")
    feed_slices(spark, sf, lambda feed: live.stream_predictions(feed, out, state, chk, TTL_S))
    return spark.read.parquet(out).select("batch", "vehicle_id", "frame_ts", "ts")
