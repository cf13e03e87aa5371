"""Change capture, replay, recordings and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import capture as cp
from fleetlens.operators import recording as rec
from fleetlens.plans import testbed as tb
from fleetlens.plans.oracle import cte, sql
from fleetlens.plans.registry import query, r, rq
from fleetlens.session import shared_dir
from fleetlens.sources import frames as fr

CYCLE_S = 300
PAUSE_S = 900
EVERY = 20
FIELDS = ["label", "route_id", "direction_id", "start_date", "start_time", "lat", "lon", "speed", "ts"]

# a vehicle is listed in the cycle of its ping and, unless it reports again, in the next one;
# every 31 cycles the recorder pauses for PAUSE_S
cte(
    "snap",
    f"""select * exclude (rn) replace (frame_ts + frame_ts // {31 * CYCLE_S} * {PAUSE_S} as frame_ts, ts + frame_ts // {31 * CYCLE_S} * {PAUSE_S} as ts) from (select frame_ts, id, {', '.join(FIELDS)}, row_number() over (partition by frame_ts, id order by ts desc, event_id desc) as rn from (
  select p.ts - p.ts % {CYCLE_S} + d.d as frame_ts, p.vehicle_id as id, p.event_id, p.label, p.route_id, p.direction_id, p.start_date, p.start_time, p.lat, p.lon, p.speed, p.ts
  from pings p, (select unnest([0, {CYCLE_S}]) as d) d)) where rn = 1""",
    "pings",
)
cte("cyc0", "select frame_ts, row_number() over (order by frame_ts) - 1 as cycle_no, max(ts) as t from snap group by frame_ts", "snap")
cte(
    "cyc",
    f"""select *, coalesce(since_s > 600, false) as after_gap, coalesce(since_s > 600, false) or cycle_no % {EVERY} = 0 as keyframe from (select *, frame_ts - lag(frame_ts) over (order by frame_ts) as since_s from cyc0)""",
    "cyc0",
)


def snapshots(spark, sf):
    p = tb.pings(spark, sf).withColumn("frame_ts", F.explode(F.array(*[F.col("ts") - F.col("ts") % CYCLE_S + d for d in (0, CYCLE_S)])))
    last = p.groupBy("frame_ts", F.col("vehicle_id").alias("id")).agg(F.max_by(F.struct(*FIELDS), F.struct("ts", "event_id")).alias("v"))
    late = F.floor(F.col("frame_ts") / (31 * CYCLE_S)) * PAUSE_S
    return last.select("frame_ts", "id", "v.*").withColumns({"frame_ts": F.col("frame_ts") + late, "ts": F.col("ts") + late})


def snap_table(spark, sf):
    return tb.stage(spark, sf, "snapshots", lambda: snapshots(spark, sf))


def cycles(spark, sf):
    return cp.mark_keyframes(cp.number_cycles(snap_table(spark, sf)), every=EVERY)


@query("mark_keyframes", sql("select frame_ts, cycle_no, since_s, after_gap, keyframe from cyc", "cyc"))
def mark_keyframes(spark, sf):
    return cycles(spark, sf).select("frame_ts", "cycle_no", "since_s", "after_gap", "keyframe")


@query(
    "gap_records",
    sql("select cycle_no, frame_ts as t, true as gap, since_s as gap_seconds, 'restart' as reason from cyc where after_gap", "cyc"),
)
def gap_records(spark, sf):
    return cp.gap_records(cycles(spark, sf))


DYN = ["lat", "lon", "speed", "route_id", "direction_id", "start_time"]
cte("numbered", "select s.*, c.cycle_no, c.keyframe from snap s join cyc c using (frame_ts)", "snap", "cyc")
cte(
    "changes",
    f"""select * from (select coalesce(a.cycle_no, b.cycle_no + 1) as cycle_no, coalesce(a.id, b.id) as id, a.ts, a.lat, a.speed,
  case when a.id is null then 'del' when b.id is null or a.keyframe then 'new' when {' or '.join(f'a.{c} <> b.{c}' for c in DYN)} then 'upd' end as op,
  concat_ws(',', {', '.join(f"case when a.{c} <> b.{c} then '{c}' end" for c in DYN)}) as changed
  from numbered a full join numbered b on a.id = b.id and a.cycle_no = b.cycle_no + 1) where op in ('new', 'upd') or (op = 'del' and cycle_no in (select cycle_no from cyc where not keyframe))""",
    "numbered",
    "cyc",
)


@query(
    "change_rows",
    sql(
        f"""select cycle_no, op, id, case when op = 'upd' then changed end as changed, case when op <> 'del' then ts end as ts,
        {rq("case when op = 'new' or (op = 'upd' and changed like '%lat%') then lat end", 'lat', 8)}, {rq("case when op = 'new' or (op = 'upd' and changed like '%speed%') then speed end", 'speed')} from changes""",
        "changes",
    ),
)
def change_rows(spark, sf):
    rows = cp.change_rows(snap_table(spark, sf), cycles(spark, sf))
    return rows.select(
        "cycle_no", "op", "id", F.when(F.col("op") == "upd", F.concat_ws(",", "changed")).alias("changed"), F.col("vehicle.ts").alias("ts"),
        r("vehicle.lat", 8).alias("lat"), r("vehicle.speed").alias("speed"),
    )


cte(
    "frame_sizes",
    """select c.cycle_no, c.t, c.keyframe, cast(coalesce(sum(case when op = 'new' then 1 else 0 end), 0) as bigint) as n_new, cast(coalesce(sum(case when op = 'del' then 1 else 0 end), 0) as bigint) as n_del,
  cast(coalesce(sum(case when op = 'upd' then 1 else 0 end), 0) as bigint) as n_upd from cyc c left join changes x using (cycle_no) group by c.cycle_no, c.t, c.keyframe""",
    "cyc",
    "changes",
)


def frames(spark, sf, per_line=40):
    """Encoded frames; a small line size so that large frames span several lines."""
    return cp.encode_deltas(snap_table(spark, sf), cycles(spark, sf), changes_per_line=per_line)


@query(
    "frame_counts",
    sql(
        "select f.cycle_no, f.t, f.keyframe, f.n_new, f.n_del, f.n_upd, coalesce(n.n, 0) as n_vehicles from frame_sizes f left join (select cycle_no, count(*) as n from numbered group by cycle_no) n using (cycle_no)",
        "frame_sizes",
        "numbered",
    ),
)
def frame_counts(spark, sf):
    return cp.frame_counts(frames(spark, sf)).select("cycle_no", "t", "keyframe", *[F.col(c).cast("long").alias(c) for c in ("n_new", "n_del", "n_upd", "n_vehicles")])


@query("encode_deltas", sql("select cycle_no, id, op from changes", "changes"))
def encode_deltas(spark, sf):
    f = frames(spark, sf)
    ids = F.concat(
        F.transform("new", lambda v: F.struct(v["id"].alias("id"), F.lit("new").alias("op"))),
        F.transform("del", lambda v: F.struct(v.alias("id"), F.lit("del").alias("op"))),
        F.transform("upd", lambda v: F.struct(v["id"].alias("id"), F.lit("upd").alias("op"))),
    )
    return f.select("cycle_no", F.explode(ids).alias("x")).select("cycle_no", "x.id", "x.op")


def recording(spark, sf):
    return tb.stage(spark, sf, "recording", lambda: cp.recording(frames(spark, sf), cp.gap_records(cycles(spark, sf))))


cte(
    "recorded",
    """select row_number() over (order by cycle_no, kind) - 1 as frame_no, * from (select cycle_no, 1 as kind, t, keyframe, false as gap, n_new, n_del, n_upd from frame_sizes
  union all select cycle_no, 0, frame_ts, false, true, 0, 0, 0 from cyc where after_gap)""",
    "frame_sizes",
    "cyc",
)


@query("read_frames", sql("select frame_no, t, keyframe, gap, n_new, n_del, n_upd from recorded", "recorded"))
def read_frames(spark, sf):
    """The recording written as compressed daily NDJSON and scanned back."""
    path = shared_dir(spark, "ndjson")
    fr.write_frames(recording(spark, sf), path)
    back = fr.read_frames(spark, path)
    n = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0))).cast("long")
    return back.groupBy(
        "frame_no", "t", F.coalesce("keyframe", F.lit(False)).alias("keyframe"), F.coalesce("gap", F.lit(False)).alias("gap")
    ).agg(n("new").alias("n_new"), n("del").alias("n_del"), n("upd").alias("n_upd"))


@query(
    "write_frames",
    sql("select strftime(epoch_ms((t - 10800)*1000), '%Y-%m-%d') as day, count(*) as n_frames, min(t) as first_t, max(t) as last_t from recorded group by all", "recorded"),
)
def write_frames(spark, sf):
    path = shared_dir(spark, "ndjson")
    fr.write_frames(recording(spark, sf), path)
    back = fr.read_frames(spark, path).where("part = 0")
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n_frames"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


INTERVAL = 700
cte("next_frame", f"select a.cycle_no, min(b.cycle_no) as next_no from cyc a join cyc b on b.cycle_no > a.cycle_no and (b.keyframe or b.t - a.t >= {INTERVAL}) group by a.cycle_no", "cyc")
cte("rec_kept", "select cast(0 as bigint) as cycle_no union all select n.next_no from rec_kept k join next_frame n on n.cycle_no = k.cycle_no", "next_frame")


@query("sample_frames", sql("select c.t as frame_ts from rec_kept k join cyc c using (cycle_no)", "rec_kept", "cyc"))
def sample_frames(spark, sf):
    return cp.sample_frames(recording(spark, sf), INTERVAL).select("frame_ts")


cte("replayed", "select c.t as frame_t, s.* from rec_kept k join cyc c using (cycle_no) join snap s on s.frame_ts = c.frame_ts", "rec_kept", "cyc", "snap")


@query("replay", sql(f"select frame_t as frame_ts, id, ts, label, route_id, direction_id, {rq('lat', None, 8)}, {rq('speed')} from replayed", "replayed"))
def replay(spark, sf):
    back = cp.replay(recording(spark, sf), INTERVAL)
    return back.select("frame_ts", "id", "ts", "label", "route_id", "direction_id", r("lat", 8).alias("lat"), r("speed").alias("speed"))


@query(
    "replay_lines",
    sql(f"select r.frame_t as frame_ts, r.id, r.ts, {rq('r.lat', 'lat', 8)} from replayed r join label_map m on m.suffix = split_part(r.label, '-', -1) where m.line in ('39', '26')", "replayed", "label_map"),
)
def replay_lines(spark, sf):
    back = cp.replay(recording(spark, sf), INTERVAL, tb.label_map(spark), ["39", "26"])
    return back.select("frame_ts", "id", "ts", r("lat", 8).alias("lat"))


@query("observations", sql("select id as vehicle_id, ts, min(frame_t) as frame_ts from replayed group by id, ts", "replayed"))
def observations(spark, sf):
    return cp.observations(cp.replay(recording(spark, sf), INTERVAL)).select("vehicle_id", "ts", "frame_ts")


@query("observations_raw", sql("select id as vehicle_id, ts, frame_t as frame_ts from replayed", "replayed"))
def observations_raw(spark, sf):
    return cp.observations(cp.replay(recording(spark, sf), INTERVAL), dedupe=False).select("vehicle_id", "ts", "frame_ts")


cte("carry_src", "select p.*, max(ts) over (partition by vehicle_id, day) as day_end from pings p", "pings")


@query(
    "with_carry",
    sql(
        """select event_id, vehicle_id, ts, day, false as carried from pings union all
        select event_id, vehicle_id, ts, strftime(cast(day as date) + 1, '%Y-%m-%d'), true from carry_src where ts >= day_end - 300 and strftime(cast(day as date) + 1, '%Y-%m-%d') in (select day from pings)""",
        "carry_src",
        "pings",
    ),
)
def with_carry(spark, sf):
    return cp.with_carry(tb.pings(spark, sf).select("event_id", "vehicle_id", "ts", "day"), window_s=300)


MID = 17_053_000
RATE_FIELDS = ["route_id", "direction_id", "start_date", "speed", "lat"]
SIDE = """select * from (select case when cast(vehicle_id as bigint) % {m} = 0 then '{m}-' || vehicle_id else vehicle_id end as id, {f}, row_number() over (partition by vehicle_id order by ts desc, event_id desc) as rn from pings where ts {op} {mid}) where rn = 1"""
cte("side_prev", SIDE.format(f=", ".join(RATE_FIELDS), op="<", mid=MID, m=7), "pings")
cte("side_curr", SIDE.format(f=", ".join(RATE_FIELDS), op=">=", mid=MID, m=11), "pings")


@query(
    "change_rates",
    sql(
        "select x.field, cast(x.n as bigint) as n_changed, " + rq("100.0*x.n/greatest(n_common, 1)", "pct_changed", 4) + ", n_common, n_new, n_deleted, n_unchanged from (select "
        + ", ".join(f"sum(case when p.id is not null and c.id is not null and p.{f} <> c.{f} then 1 else 0 end) as n_{f}" for f in RATE_FIELDS)
        + """, cast(sum(case when p.id is not null and c.id is not null then 1 else 0 end) as bigint) as n_common, cast(sum(case when p.id is null then 1 else 0 end) as bigint) as n_new, cast(sum(case when c.id is null then 1 else 0 end) as bigint) as n_deleted,
        cast(sum(case when p.id is not null and c.id is not null and """
        + " and ".join(f"p.{f} = c.{f}" for f in RATE_FIELDS)
        + """ then 1 else 0 end) as bigint) as n_unchanged from side_prev p full join side_curr c on p.id = c.id) t, lateral (select unnest(["""
        + ", ".join(f"{{'field': '{f}', 'n': n_{f}}}" for f in RATE_FIELDS)
        + "]) as x)",
        "side_prev",
        "side_curr",
    ),
)
def change_rates(spark, sf):
    p = tb.pings(spark, sf)
    # some vehicles bear another id on each side, so that ids come and go
    named = lambda m: F.when(k % m == 0, F.concat(F.lit(f"{m}-"), "vehicle_id")).otherwise(F.col("vehicle_id")).alias("id")
    last = lambda d, m: d.groupBy(named(m)).agg(F.max_by(F.struct(*RATE_FIELDS), F.struct("ts", "event_id")).alias("v")).select("id", "v.*")
    k = F.col("vehicle_id").cast("long")
    rates = cp.change_rates(last(p.where(F.col("ts") < MID), 7), last(p.where(F.col("ts") >= MID), 11), RATE_FIELDS)
    return rates.withColumn("pct_changed", r("pct_changed", 4))


@query(
    "max_fleet_per_line",
    sql(
        """select line, max(n) as max_vehicles, count(*) as n_frames from (select m.line, s.frame_ts, count(*) as n from snap s join label_map m on m.suffix = split_part(s.label, '-', -1) group by all) group by line""",
        "snap",
        "label_map",
    ),
)
def max_fleet_per_line(spark, sf):
    from fleetlens.operators.filters import resolve_line

    return cp.max_fleet_per_line(resolve_line(snap_table(spark, sf), tb.label_map(spark)))


# raw recording lines, one per event, with gaps, broken and blank lines
LINE_SQL = """case when event_id % 97 = 13 then 'broken{' when event_id % 89 = 7 then '' when event_id % 101 = 0 then '{"t": ' || ts || ', "gap": true, "gap_seconds": 700}'
  when event_id % 50 = 0 then '{"t": ' || ts || ', "keyframe": true, "new": [' || vs || '], "del": [], "upd": []}' else '{"t":' || ts || ',"new":[],"del":["9"],"upd":[' || vs || ']}' end"""
cte(
    "raw_lines",
    f"select event_id, day, ts, event_id % 4 as k, {LINE_SQL} as text from (select event_id, day, ts, array_to_string(list_transform(range(0, event_id % 4), lambda i: '{{\"id\": \"' || i || '\"}}'), ', ') as vs from pings)",
    "pings",
)
cte(
    "parsed_lines",
    "select *, case when event_id % 101 = 0 then 'gap' when event_id % 50 = 0 then 'keyframe' else 'delta' end as kind, length(text) + 1 as n from raw_lines where event_id % 97 <> 13 and event_id % 89 <> 7",
    "raw_lines",
)


def raw_lines(spark, sf):
    e = F.col("event_id")
    vs = F.concat_ws(
        ", ", F.transform(F.slice(F.array(*[F.lit(i) for i in range(3)]), F.lit(1), (e % 4).cast("int")), lambda i: F.concat(F.lit('{"id": "'), i.cast("string"), F.lit('"}')))
    )
    t = F.col("ts").cast("string")
    text = (
        F.when(e % 97 == 13, "broken{")
        .when(e % 89 == 7, "")
        .when(e % 101 == 0, F.concat(F.lit('{"t": '), t, F.lit(', "gap": true, "gap_seconds": 700}')))
        .when(e % 50 == 0, F.concat(F.lit('{"t": '), t, F.lit(', "keyframe": true, "new": ['), vs, F.lit('], "del": [], "upd": []}')))
        .otherwise(F.concat(F.lit('{"t":'), t, F.lit(',"new":[],"del":["9"],"upd":['), vs, F.lit("]}")))
    )
    return tb.pings(spark, sf).select("event_id", "day", text.alias("text"))


@query(
    "quick_counts",
    sql(
        """select day, keyframes, deltas, gaps, keyframes + deltas as total_cycles from (select day, cast(sum(case when text like '%"keyframe": true%' then 1 else 0 end) as bigint) as keyframes,
        cast(sum(case when text not like '%"keyframe": true%' and text not like '%"gap": true%' and text <> '' then 1 else 0 end) as bigint) as deltas, cast(sum(case when text like '%"gap": true%' then 1 else 0 end) as bigint) as gaps from raw_lines group by day)""",
        "raw_lines",
    ),
)
def quick_counts(spark, sf):
    return rec.quick_counts(raw_lines(spark, sf))


STATS = """select day, cast(sum(case when kind = 'keyframe' then 1 else 0 end) as bigint) as keyframes, cast(sum(case when kind = 'delta' then 1 else 0 end) as bigint) as deltas, cast(sum(case when kind = 'gap' then 1 else 0 end) as bigint) as gaps,
  cast(coalesce(sum(case when kind = 'keyframe' then n end), 0) as bigint) as kf_bytes, cast(coalesce(sum(case when kind = 'delta' then n end), 0) as bigint) as delta_bytes, cast(coalesce(floor(avg(case when kind = 'keyframe' then k end)), 0) as bigint) as avg_kf_veh,
  cast(coalesce(floor(avg(case when kind = 'delta' then k end)), 0) as bigint) as avg_delta_upd, arg_min(ts, event_id) as first_ts, arg_max(ts, event_id) as last_ts from parsed_lines group by day"""
cte("day_stats", f"select *, keyframes + deltas as total_cycles, last_ts - first_ts as duration_s from ({STATS})", "parsed_lines")
STAT_COLS = "day, keyframes, deltas, gaps, kf_bytes, delta_bytes, avg_kf_veh, avg_delta_upd, first_ts, last_ts, total_cycles, duration_s"


@query("file_stats", sql(f"select {STAT_COLS} from day_stats", "day_stats"))
def file_stats(spark, sf):
    return rec.file_stats(raw_lines(spark, sf), ["event_id"]).select(*STAT_COLS.split(", "))


cte("day_sizes", "select day, cast(sum(strlen(text) + 1) as bigint) as bytes from raw_lines group by day", "raw_lines")


def day_sizes(spark, sf):
    """Sizes of the files that the recorded lines of each day are written to."""
    path = shared_dir(spark, "days")
    raw_lines(spark, sf).select("day", "text").write.partitionBy("day").text(path)
    return rec.file_sizes(fr.scan_lines(spark, path))


LIMIT = 20_700


@query(
    "storage_summary",
    sql(
        f"""select n_days, total_bytes, n_full_days, {rq('avg_bytes', None, 3)}, {rq('avg_bytes*30', 'month_bytes', 3)}, {rq('avg_bytes*365', 'year_bytes', 3)}, min_day, min_bytes, max_day, max_bytes from (
        select count(*) as n_days, cast(sum(bytes) as bigint) as total_bytes, count(case when bytes > {LIMIT} then 1 end) as n_full_days, coalesce(avg(case when bytes > {LIMIT} then bytes end), 0.0) as avg_bytes, arg_min(day, (bytes, day)) as min_day, min(bytes) as min_bytes,
        arg_min(day, (-bytes, day)) as max_day, max(bytes) as max_bytes from day_sizes)""",
        "day_sizes",
    ),
)
def storage_summary(spark, sf):
    s = rec.storage_summary(day_sizes(spark, sf), full_day=LIMIT)
    return s.select(*[r(c, 3).alias(c) if c in ("avg_bytes", "month_bytes", "year_bytes") else F.col(c) for c in s.columns])


@query(
    "day_progress",
    sql(
        f"select day, {rq('duration_s/86400*100', 'pct_done', 5)}, {rq('(kf_bytes + delta_bytes)/bytes', 'ratio')}, {rq('case when duration_s > 0 then bytes/(duration_s/86400) end', 'projected_bytes', 2)} from day_stats join day_sizes using (day)",
        "day_stats",
        "day_sizes",
    ),
)
def day_progress(spark, sf):
    p = rec.day_progress(rec.file_stats(raw_lines(spark, sf), ["event_id"]), day_sizes(spark, sf))
    return p.select("day", r("pct_done", 5).alias("pct_done"), r("ratio").alias("ratio"), r("projected_bytes", 2).alias("projected_bytes"))


@query(
    "daily_breakdown",
    sql("select day, bytes, keyframes + deltas as total_cycles, keyframes, deltas, gaps from day_stats full join day_sizes using (day)", "day_stats", "day_sizes"),
)
def daily_breakdown(spark, sf):
    return rec.daily_breakdown(rec.file_stats(raw_lines(spark, sf), ["event_id"]), day_sizes(spark, sf))


@query(
    "select_days",
    sql("select event_id, day from pings where day in (select day from (select day, row_number() over (order by day) as n from (select distinct day from pings where day <> '2024-01-10')) where n > 2 and n <= 12)", "pings"),
)
def select_days(spark, sf):
    return fr.select_days(tb.pings(spark, sf).select("event_id", "day"), skip_first=2, max_days=10, exclude="2024-01-10")


@query("count_days", sql("select count(distinct day) as n_days from pings", "pings"))
def count_days(spark, sf):
    return fr.count_days(fr.require_days(tb.pings(spark, sf), 5))


# feed rows with unrounded numbers and some outside the service area
cte(
    "feed",
    "select event_id, vehicle_id as id, label, route_id, direction_id, start_date, start_time, lat + case when event_id % 10 = 0 then 1.5::double else event_id*0.000000137::double end as lat, lon, speed/7 as speed, ts from pings",
    "pings",
)


def feed(spark, sf):
    e = F.col("event_id")
    blank = {"license_plate": "string", "trip_id": "string", "stop_id": "string", "odo": "long", "seq": "int", "status": "int"}
    p = tb.pings(spark, sf)
    return p.select(
        "event_id",
        F.col("vehicle_id").alias("id"),
        "label", "route_id", "direction_id", "start_date", "start_time",
        (F.col("lat") + F.when(e % 10 == 0, 1.5).otherwise(e.cast("double") * 0.000000137)).alias("lat"),
        "lon",
        (F.col("speed") / 7).alias("speed"),
        "ts",
        *[F.lit(None).cast(t).alias(c) for c, t in blank.items()],
    )


@query(
    "normalize_feed",
    sql(f"select id, ts, {rq('lat')}, {rq('lon')}, {rq('speed', None, 2)}, route_id from feed where lat between -35.1 and -34.3 and lon between -59.1 and -57.9", "feed"),
)
def normalize_feed(spark, sf):
    n = fr.normalize_feed(feed(spark, sf))
    return n.select("id", "ts", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("lat", "lon", "speed")], "route_id")


cte(
    "live_raw",
    """select event_id as pos, case when event_id % 3 = 0 then cast(vehicle_id as varchar) else '' end as a_id, case when event_id % 3 = 0 then 'old' when event_id % 50 = 1 then '' else vehicle_id end as b_id,
  case when event_id % 2 = 0 then lat else 0 end as a_lat, case when event_id % 40 = 0 then 0.0 else lat end as b_lat, lon, case when event_id % 4 = 0 then '' else route_id end as a_route, 'r' || route_id as b_route, case when event_id % 5 = 0 then 0 else ts end as ts, line from lined""",
    "lined",
)


def live_raw(spark, sf):
    e = F.col("event_id")
    p = tb.lined_pings(spark, sf)
    none = lambda t: F.lit(None).cast(t)
    return p.select(
        e.alias("pos"),
        F.when(e % 3 == 0, F.col("vehicle_id")).otherwise("").alias("VP_vehicle_id"),
        F.when(e % 3 == 0, "old").when(e % 50 == 1, "").otherwise(F.col("vehicle_id")).alias("id"),
        F.when(e % 2 == 0, F.col("lat")).otherwise(0.0).alias("VP_latitude"),
        F.when(e % 40 == 0, 0.0).otherwise(F.col("lat")).alias("lat"),
        none("double").alias("VP_longitude"), "lon",
        F.when(e % 4 == 0, "").otherwise(F.col("route_id")).alias("VP_route_id"),
        F.concat(F.lit("r"), "route_id").alias("route_id"),
        none("int").alias("VP_direction_id"), "direction_id", none("double").alias("VPS_speed"), "speed",
        F.when(e % 5 == 0, 0).otherwise(F.col("ts")).alias("VP_timestamp"), none("long").alias("ts"),
        none("string").alias("LD_label"), none("string").alias("VP_label"), "label", none("string").alias("LD_linea"), F.col("line").alias("line_number"),
    )


@query(
    "normalize_live",
    sql(
        f"""select vehicle_id, {rq('lat', None, 8)}, route_id, ts, line from (select *, row_number() over (partition by vehicle_id order by pos desc) as rn from (
        select pos, case when a_id <> '' then a_id else b_id end as vehicle_id, case when a_lat <> 0 then a_lat else b_lat end as lat, lon, case when a_route <> '' then a_route else b_route end as route_id,
        case when ts = 0 then {tb.NOW} else ts end as ts, line from live_raw) where vehicle_id <> '' and lat between -35.1 and -34.3 and lon between -59.1 and -57.9) where rn = 1""",
        "live_raw",
    ),
)
def normalize_live(spark, sf):
    return fr.normalize_live(live_raw(spark, sf), tb.NOW).select("vehicle_id", r("lat", 8).alias("lat"), "route_id", "ts", "line")
