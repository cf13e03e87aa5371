"""ETA features and the training table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import features as fx
from fleetlens.operators import geometry
from fleetlens.plans import testbed as tb
from fleetlens.plans.oracle import cte, sql
from fleetlens.plans.registry import query, r, rq

# civil time on the uncompressed clock, so that every hour and weekday appears
cte(
    "timed",
    """select *, 2*pi()*hh/24 as angle, extract(isodow from lt) - 1 as dow from (select *, extract(hour from lt) + extract(minute from lt)/60.0::double + extract(second from lt)/3600.0::double as hh
  from (select *, epoch_ms(cast((raw_epoch - 10800)*1000 as bigint)) as lt from proj))""",
    "proj",
)


def timed(points):
    return fx.encode_time(points, ts="raw_epoch")


@query(
    "encode_time",
    sql(f"select event_id, {rq('sin(angle)', 'hour_sin')}, {rq('cos(angle)', 'hour_cos')}, cast(dow as integer) as dow from timed", "timed"),
)
def encode_time(spark, sf):
    return timed(tb.projected_table(spark, sf)).select("event_id", r("hour_sin").alias("hour_sin"), r("hour_cos").alias("hour_cos"), "dow")


@query("segment_index", sql("select event_id, cast(floor(along_m/500.0) as integer) as seg_idx from proj", "proj"))
def segment_index(spark, sf):
    return tb.projected_table(spark, sf).select("event_id", fx.segment_index(F.col("along_m")).alias("seg_idx"))


cte(
    "feat",
    """select *, row_number() over w - 1 as pos, count(*) over (partition by vehicle_id, trip_no) as n_pos, along_m/length_m as dist_along_norm,
  cast(least(frame_ts - ts, 600) as double) as ts_age_s, cast(ts - min(ts) over (partition by vehicle_id, trip_no) as double) as time_since_start,
  cast(floor(along_m/500.0) as integer) as seg_idx from timed where mapped window w as (partition by vehicle_id, trip_no order by ts, event_id)""",
    "timed",
)


@query(
    "point_scalars",
    sql(
        f"select event_id, pos, n_pos, {rq('dist_along_norm')}, ts_age_s, time_since_start, seg_idx from feat",
        "feat",
    ),
)
def point_scalars(spark, sf):
    return fx.point_scalars(fx.renumber(tb.projected_table(spark, sf).where("mapped"))).select(
        "event_id", "pos", "n_pos", r("dist_along_norm").alias("dist_along_norm"), "ts_age_s", "time_since_start", "seg_idx"
    )


@query(
    "future_pairs",
    sql(
        f"""select p.event_id, f.event_id as f_event_id, {rq('f.along_m - p.along_m', 'dist_remaining_m', 4)}, cast(f.ts - p.ts as double) as observed_eta_s
        from feat p join feat f on f.vehicle_id = p.vehicle_id and f.trip_no = p.trip_no and f.pos > p.pos and f.along_m - p.along_m >= 100 and f.ts > p.ts""",
        "feat",
    ),
)
def future_pairs(spark, sf):
    pts = fx.renumber(tb.projected_table(spark, sf).where("mapped"))
    # small blocks here, so that the blocked join path is exercised
    return fx.future_pairs(pts, ["event_id"], ["event_id"], block=4).select(
        "event_id", "f_event_id", r("dist_remaining_m", 4).alias("dist_remaining_m"), "observed_eta_s"
    )


# position k of the history is 3k+1..3k+3 in the flat list; weights expose order and padding
cte(
    "traj",
    """select p.event_id, cast(count(*) as integer) as traj_len, sum((3*k+1)*d) + sum((3*k+2)*speed) + sum((3*k+3)*dt) as traj_check, sum(dt) as dt_sum from (
  select p.event_id, h.dist_along_norm as d, h.speed, row_number() over w - 1 as k, case when row_number() over w = 1 then 0.0 else h.ts - lag(h.ts) over w end as dt
  from feat p join feat h on h.vehicle_id = p.vehicle_id and h.trip_no = p.trip_no and h.pos between p.pos - 9 and p.pos
  window w as (partition by p.event_id order by h.pos)) p group by p.event_id""",
    "feat",
)


def checksum(col):
    """Position-weighted sum of an array."""
    return F.aggregate(F.transform(col, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query("trajectory", sql(f"select event_id, traj_len, {rq('traj_check', None, 4)}, 30 as width from traj", "traj"))
def trajectory(spark, sf):
    pts = fx.point_scalars(fx.renumber(tb.projected_table(spark, sf).where("mapped")))
    return fx.trajectory(pts, block=16).select(
        "event_id", "traj_len", r(checksum("traj_flat"), 4).alias("traj_check"), F.size("traj_flat").alias("width")
    )


cte(
    "fleet_rows",
    """select * exclude (rn) from (select line, frame_ts, vehicle_id, ts, lat, lon, speed, direction_id,
  row_number() over (partition by line, frame_ts, vehicle_id order by ts desc, lat desc, lon desc) as rn from lined where line is not null) where rn = 1""",
    "lined",
)
FLEET_SQL = """select p.event_id, row_number() over (partition by p.event_id order by f.vehicle_id) - 1 as k,
  (f.lat + 34.6::double)*10 as a, (f.lon + 58.4::double)*10 as b, f.speed, f.direction_id, case when f.direction_id = p.trip_direction_id then 1.0 else 0.0 end as same
  from feat p join fleet_rows f on f.line = p.line and f.frame_ts = p.{at} and f.vehicle_id <> p.vehicle_id"""
cte("fleet_long", "select * from (" + FLEET_SQL.format(at="frame_ts") + ") where k < 3", "feat", "fleet_rows")
cte(
    "fleet_ctx",
    """select p.event_id, cast(count(x.k) as integer) as n_fleet, coalesce(sum((5*k+1)*a + (5*k+2)*b + (5*k+3)*x.speed + (5*k+4)*x.direction_id + (5*k+5)*same), 0.0) as fleet_check
  from feat p left join fleet_long x using (event_id) group by p.event_id""",
    "feat",
    "fleet_long",
)


@query("fleet_context", sql(f"select event_id, n_fleet, {rq('fleet_check', None, 8)}, 15 as width from fleet_ctx", "fleet_ctx"))
def fleet_context(spark, sf):
    pts = tb.projected_table(spark, sf).where("mapped")
    table = fx.fleet_table(tb.lined_pings(spark, sf), cap=3)
    return fx.fleet_context(pts, table, cap=3).select(
        "event_id", "n_fleet", r(checksum("fleet_flat"), 8).alias("fleet_check"), F.size("fleet_flat").alias("width")
    )


cte(
    "fleet_exact",
    "select p.event_id, cast(count(x.k) as integer) as n_fleet from feat p left join (select * from (" + FLEET_SQL.format(at="ts") + ") where k < 60) x using (event_id) group by p.event_id",
    "feat",
    "fleet_rows",
)


@query("fleet_context_exact", sql("select event_id, n_fleet from fleet_exact", "fleet_exact"))
def fleet_context_exact(spark, sf):
    table = fx.fleet_table(tb.lined_pings(spark, sf))
    return fx.fleet_context(tb.projected_table(spark, sf).where("mapped"), table, match="exact").select("event_id", "n_fleet")


cte(
    "branch_trips",
    """select shape_id, vehicle_id, trip_no, trip_start_ts, min(case when offset_m < 150 then ts end) as first_ts, sum(case when offset_m < 150 then 1 else 0 end) >= 2 as eligible
  from feat group by shape_id, vehicle_id, trip_no, trip_start_ts""",
    "feat",
)
cte(
    "eligible",
    "select *, row_number() over (partition by shape_id order by trip_start_ts, vehicle_id, trip_no) - 1 as seq from branch_trips where eligible",
    "branch_trips",
)
cte(
    "history",
    """select shape_id, vehicle_id, trip_no, seq, prev_vehicle, prev_trip_no, first_ts, age from (
  select t.shape_id, t.vehicle_id, t.trip_no, e.seq, e.vehicle_id as prev_vehicle, e.trip_no as prev_trip_no, e.first_ts,
    row_number() over (partition by t.shape_id, t.vehicle_id, t.trip_no order by e.seq desc) as age
  from branch_trips t join eligible e on e.shape_id = t.shape_id and (e.trip_start_ts, e.vehicle_id, e.trip_no) < (t.trip_start_ts, t.vehicle_id, t.trip_no)) where age <= 10""",
    "branch_trips",
    "eligible",
)


@query("passage_history", sql("select vehicle_id, trip_no, cast(age as integer) as age, prev_vehicle, prev_trip_no, first_ts from history", "history"))
def passage_history(spark, sf):
    pts = tb.projected_table(spark, sf).where("mapped")
    hist = fx.passage_history(pts, fx.eligible_trips(pts))
    return hist.select("vehicle_id", "trip_no", F.posexplode("history").alias("age", "h")).select(
        "vehicle_id", "trip_no", (F.col("age") + 1).alias("age"), "h.prev_vehicle", "h.prev_trip_no", "h.first_ts"
    )


cte(
    "prev_trip",
    """select event_id, seq, prev_vehicle, prev_trip_no from (select p.event_id, h.seq, h.prev_vehicle, h.prev_trip_no, row_number() over (partition by p.event_id order by h.seq desc) as rn
  from feat p join history h on h.shape_id = p.shape_id and h.vehicle_id = p.vehicle_id and h.trip_no = p.trip_no and h.prev_vehicle <> p.vehicle_id and h.first_ts < p.ts) where rn = 1""",
    "feat",
    "history",
)


@query(
    "previous_trip",
    sql("select p.event_id, x.prev_vehicle, x.prev_trip_no from feat p left join prev_trip x using (event_id)", "feat", "prev_trip"),
)
def previous_trip(spark, sf):
    pts = tb.projected_table(spark, sf).where("mapped")
    out = fx.previous_trip(pts, fx.passage_history(pts, fx.eligible_trips(pts)))
    return out.select("event_id", F.col("prev.prev_vehicle").alias("prev_vehicle"), F.col("prev.prev_trip_no").alias("prev_trip_no"))


cte(
    "pairs",
    """select p.event_id, f.event_id as f_event_id, p.shape_id as ramal_id, p.vehicle_id, p.trip_no, p.pos as p_pos, f.pos as f_pos, p.seg_idx, f.along_m - p.along_m as dist_remaining_m,
  p.dist_along_norm, p.speed as speed_mps, sin(p.angle) as hour_sin, cos(p.angle) as hour_cos, p.dow, cast(f.ts - p.ts as double) as observed_eta_s, p.time_since_start, p.ts_age_s,
  p.line, p.day, p.ts, f.along_m as f_along_m, x.prev_vehicle, x.prev_trip_no
  from feat p join feat f on f.vehicle_id = p.vehicle_id and f.trip_no = p.trip_no and f.pos > p.pos and f.along_m - p.along_m >= 100 and f.ts > p.ts
  left join prev_trip x on x.event_id = p.event_id""",
    "feat",
    "prev_trip",
)
cte(
    "around",
    """select q.prev_vehicle, q.prev_trip_no, q.f_along_m, max(case when t.along_m < q.f_along_m then struct_pack(d := t.along_m, t := t.ts) end) as lo,
  min(case when t.along_m >= q.f_along_m then struct_pack(d := t.along_m, t := t.ts) end) as hi
  from (select distinct prev_vehicle, prev_trip_no, f_along_m from pairs where prev_vehicle is not null) q
  join feat t on t.vehicle_id = q.prev_vehicle and t.trip_no = q.prev_trip_no and t.offset_m < 150 group by all""",
    "pairs",
    "feat",
)
cte(
    "since",
    """select event_id, f_event_id, case when lo is not null and hi is not null and hi.d > lo.d and at_s < ts then ts - at_s
    when lo is not null and abs(lo.d - f_along_m) <= 250 and lo.t < ts then ts - lo.t when hi is not null and abs(hi.d - f_along_m) <= 250 and hi.t < ts then ts - hi.t end as raw_s from (
  select p.event_id, p.f_event_id, p.ts, p.f_along_m, a.lo, a.hi, a.lo.t + (p.f_along_m - a.lo.d)/case when a.hi.d > a.lo.d then a.hi.d - a.lo.d else 1 end*(a.hi.t - a.lo.t) as at_s
  from pairs p left join around a on a.prev_vehicle = p.prev_vehicle and a.prev_trip_no = p.prev_trip_no and a.f_along_m = p.f_along_m)""",
    "pairs",
    "around",
)
cte(
    "eta",
    """select p.*, least(coalesce(s.raw_s, 3600.0), 3600.0) as time_since_last_bus_s, s.raw_s is not null as last_bus_found
  from pairs p join since s using (event_id, f_event_id)""",
    "pairs",
    "since",
)


def features(spark, sf, arrays=False, fleet=False):
    """Point features with civil time on the uncompressed clock."""
    pts = tb.projected_table(spark, sf)
    return timed(fx.point_features(pts, tb.lined_pings(spark, sf) if fleet else None, arrays=arrays, store=tb.stored))


def eta(spark, sf):
    """The training table (without arrays), built once per application as daily training files would be."""
    return tb.stage(spark, sf, "eta", lambda: fx.eta_rows(features(spark, sf), arrays=False))


@query(
    "interp_passage",
    sql(
        f"select vehicle_id, trip_no, p_pos, f_pos, {rq('time_since_last_bus_s', None, 4)}, last_bus_found from eta",
        "eta",
    ),
)
def interp_passage(spark, sf):
    return eta(spark, sf).select("vehicle_id", "trip_no", "p_pos", "f_pos", r("time_since_last_bus_s", 4).alias("time_since_last_bus_s"), "last_bus_found")


@query(
    "eta_rows",
    sql(
        f"""select e.vehicle_id, e.trip_no, e.p_pos, e.f_pos, e.ramal_id, e.seg_idx, {rq('e.dist_remaining_m', 'dist_remaining_m', 4)}, {rq('e.dist_along_norm', 'dist_along_norm')}, {rq('e.speed_mps', 'speed_mps')},
        {rq('e.hour_sin', 'hour_sin')}, {rq('e.hour_cos', 'hour_cos')}, cast(e.dow as integer) as dow, true as has_active_bus, e.observed_eta_s, e.time_since_start, e.ts_age_s,
        {rq('t.traj_check', 'traj_check', 4)}, t.traj_len, {rq('c.fleet_check', 'fleet_check', 8)}, c.n_fleet, {rq('e.time_since_last_bus_s', 'time_since_last_bus_s', 4)}, e.last_bus_found
        from eta e join traj t on t.event_id = e.event_id join (select p.event_id, cast(count(x.k) as integer) as n_fleet,
          coalesce(sum((5*k+1)*a + (5*k+2)*b + (5*k+3)*x.speed + (5*k+4)*x.direction_id + (5*k+5)*same), 0.0) as fleet_check
          from feat p left join (select * from ({FLEET_SQL.format(at='frame_ts')}) where k < 60) x using (event_id) group by p.event_id) c on c.event_id = e.event_id""",
        "eta",
        "traj",
        "fleet_rows",
        "feat",
    ),
)
def eta_rows(spark, sf):
    rows = fx.eta_rows(features(spark, sf, arrays=True, fleet=True))
    digits = {"dist_remaining_m": 4, "time_since_last_bus_s": 4, "dist_along_norm": 6, "speed_mps": 6, "hour_sin": 6, "hour_cos": 6}
    return rows.select(
        "vehicle_id", "trip_no", "p_pos", "f_pos", "ramal_id", "seg_idx", "dow", "has_active_bus", "observed_eta_s", "time_since_start", "ts_age_s",
        "traj_len", "n_fleet", "last_bus_found",
        *[r(c, n).alias(c) for c, n in digits.items()],
        r(checksum("traj_flat"), 4).alias("traj_check"),
        r(checksum("fleet_flat"), 8).alias("fleet_check"),
    )


cte(
    "medians",
    """select ramal_id, cast(round(d*20) as integer) as bucket, median(tss) as expected_time_s, count(*) as n_obs from (
  select distinct ramal_id, cast(cast(dist_along_norm as float) as double) as d, cast(cast(time_since_start as float) as double) as tss from eta) group by all""",
    "eta",
)


@query("schedule_medians", sql(f"select ramal_id, bucket, {rq('expected_time_s', None, 4)}, n_obs from medians", "medians"))
def schedule_medians(spark, sf):
    return fx.schedule_medians(eta(spark, sf)).select("ramal_id", "bucket", r("expected_time_s", 4).alias("expected_time_s"), "n_obs")


@query(
    "monotonicity_audit",
    sql(
        """select ramal_id, count(*) as n_buckets, cast(sum(bad) as bigint) as n_violations, sum(bad) > greatest(1, floor(count(*)*0.05)) as warn from (
        select *, case when expected_time_s < 0.95*lag(expected_time_s) over (partition by ramal_id order by bucket) then 1 else 0 end as bad from medians) group by ramal_id""",
        "medians",
    ),
)
def monotonicity_audit(spark, sf):
    return fx.monotonicity_audit(fx.schedule_medians(eta(spark, sf)))


cte(
    "deviation",
    """select e.*, coalesce(least(greatest((e.time_since_start - m.expected_time_s)/600, -3), 3), 0.0) as schedule_dev_norm from eta e left join medians m on m.ramal_id = e.ramal_id
  and m.bucket = least(greatest(cast(round_even(cast(cast(e.dist_along_norm as float) as double)*20, 0) as integer), 0), 20)""",
    "eta",
    "medians",
)


@query("schedule_deviation", sql(f"select vehicle_id, trip_no, p_pos, f_pos, {rq('schedule_dev_norm', None, 5)} from deviation", "deviation"))
def schedule_deviation(spark, sf):
    train = eta(spark, sf)
    return fx.schedule_deviation(train, fx.schedule_medians(train)).select(
        "vehicle_id", "trip_no", "p_pos", "f_pos", r("schedule_dev_norm", 5).alias("schedule_dev_norm")
    )


@query(
    "normalize_scalars",
    sql(
        f"""select vehicle_id, trip_no, p_pos, f_pos, {rq('least(greatest(observed_eta_s, 1.0), 300.0)', 'eta_seconds')}, {rq('time_since_start/3600', 'time_since_start')}, {rq('ts_age_s/600', 'ts_age_s')},
        {rq('ln(1 + time_since_last_bus_s)/ln(3601)', 'time_since_last_bus_s')}, 1.0::double as has_active_bus, cast(last_bus_found as integer)::double as last_bus_found from eta""",
        "eta",
    ),
)
def normalize_scalars(spark, sf):
    n = fx.normalize_scalars(eta(spark, sf), max_eta_s=300.0)
    return n.select(
        "vehicle_id", "trip_no", "p_pos", "f_pos", "has_active_bus", "last_bus_found",
        *[r(c).alias(c) for c in ("eta_seconds", "time_since_start", "ts_age_s", "time_since_last_bus_s")],
    )


def arrays_only(spark, sf):
    """Trajectory and fleet arrays per point, without pairs."""
    pts = fx.trajectory(fx.point_scalars(fx.renumber(tb.projected_table(spark, sf).where("mapped"))))
    return fx.fleet_context(pts, fx.fleet_table(tb.lined_pings(spark, sf)))


cte(
    "traj_norm",
    """select event_id, sum((3*k+1)*least(greatest(d, 0), 1) + (3*k+2)*speed/30 + (3*k+3)*least(greatest(dt/30, 0), 5)) as norm_check from (
  select p.event_id, h.dist_along_norm as d, h.speed, row_number() over w - 1 as k, case when row_number() over w = 1 then 0.0 else h.ts - lag(h.ts) over w end as dt
  from feat p join feat h on h.vehicle_id = p.vehicle_id and h.trip_no = p.trip_no and h.pos between p.pos - 9 and p.pos
  window w as (partition by p.event_id order by h.pos)) group by event_id""",
    "feat",
)


@query("normalize_traj", sql(f"select event_id, {rq('norm_check', None, 4)} from traj_norm", "traj_norm"))
def normalize_traj(spark, sf):
    pts = fx.trajectory(fx.point_scalars(fx.renumber(tb.projected_table(spark, sf).where("mapped"))))
    return fx.normalize_traj(pts).select("event_id", r(checksum("traj_norm"), 4).alias("norm_check"))


cte("fleet_all", "select * from (" + FLEET_SQL.format(at="frame_ts") + ") where k < 60", "feat", "fleet_rows")
cte(
    "fleet_capped",
    """select p.event_id, cast(coalesce(sum(case when j <= 2 and same = 1 then 1 else 0 end), 0) as integer) as n_fleet,
  coalesce(sum(case when j <= 2 then (5*j-4)*a + (5*j-3)*b + (5*j-2)*x.speed + (5*j-1)*x.direction_id + 5*j*same end), 0.0) as fleet_check
  from feat p left join (select *, row_number() over (partition by event_id order by same desc, k) as j from fleet_all) x using (event_id) group by p.event_id""",
    "feat",
    "fleet_all",
)


@query("cap_fleet", sql(f"select event_id, n_fleet, {rq('fleet_check', None, 8)} from fleet_capped", "fleet_capped"))
def cap_fleet(spark, sf):
    return fx.cap_fleet(arrays_only(spark, sf), 2).select("event_id", "n_fleet", r(checksum("fleet_flat"), 8).alias("fleet_check"))


@query(
    "masks",
    sql(
        """select t.event_id, 10 - t.traj_len as traj_padding, 60 - cast(count(x.k) as integer) as fleet_padding from traj t left join fleet_all x using (event_id) group by t.event_id, t.traj_len""",
        "traj",
        "fleet_all",
    ),
)
def masks(spark, sf):
    m = fx.masks(arrays_only(spark, sf))
    padding = lambda c: F.size(F.filter(c, lambda x: x))
    return m.select("event_id", padding("traj_mask").alias("traj_padding"), padding("fleet_mask").alias("fleet_padding"))


@query(
    "dist_remaining_norm",
    sql(
        f"select e.vehicle_id, e.trip_no, e.p_pos, e.f_pos, {rq('e.dist_remaining_m/greatest(l.length_m, 1)', 'dist_remaining_norm')} from eta e join lengths l on l.shape_id = e.ramal_id",
        "eta",
        "lengths",
    ),
)
def dist_remaining_norm(spark, sf):
    return fx.dist_remaining_norm(eta(spark, sf), geometry.shape_lengths(tb.shapes(spark))).select(
        "vehicle_id", "trip_no", "p_pos", "f_pos", r("dist_remaining_norm").alias("dist_remaining_norm")
    )


@query(
    "valid_rows",
    sql("select vehicle_id, trip_no, p_pos, f_pos from eta where observed_eta_s > 0 and dist_remaining_m >= 100 and dist_along_norm between 0 and 1", "eta"),
)
def valid_rows(spark, sf):
    from fleetlens.operators.filters import valid_rows as keep

    return keep(eta(spark, sf)).select("vehicle_id", "trip_no", "p_pos", "f_pos")


PROFILED = ["dist_remaining_m", "dist_along_norm", "observed_eta_s"]


@query(
    "profile",
    sql(
        f"""select name, count(*) as n, cast(0 as bigint) as n_nan, cast(0 as bigint) as n_inf, count(*) as n_valid, cast(sum(case when x < lo or x > hi then 1 else 0 end) as bigint) as n_outside,
        {rq('min(x)', 'min', 4)}, {rq('max(x)', 'max', 4)}, {rq('avg(x)', 'mean', 4)}, {rq('max(abs(x)/unit)', 'max_abs', 4)}, {rq('quantile_cont(x, 0.99)', 'p99', 4)} from (
        select 'dist_remaining_m' as name, dist_remaining_m as x, 0.0 as lo, 5000.0 as hi, 1000.0 as unit from eta union all select 'dist_along_norm', dist_along_norm, 0.0, 0.5, 1.0 from eta union all select 'observed_eta_s', observed_eta_s, -1e18, 1e18, 1.0 from eta
        union all select 'traj_speed', h.speed, -1e18, 10.0, 30.0 from feat p join feat h on h.vehicle_id = p.vehicle_id and h.trip_no = p.trip_no and h.pos between p.pos - 9 and p.pos
        union all select 'traj_speed', 0.0, -1e18, 10.0, 30.0 from (select unnest(range(0, 10 - traj_len)) from traj)) group by name""",
        "eta",
        "traj",
    ),
)
def profile(spark, sf):
    pairs = fx.profile(eta(spark, sf), PROFILED, ranges={"dist_remaining_m": (0.0, 5000.0), "dist_along_norm": (0.0, 0.5)}, scales={"dist_remaining_m": 1000.0})
    pts = fx.trajectory(fx.point_scalars(fx.renumber(tb.projected_table(spark, sf).where("mapped"))))
    speeds = fx.profile(pts, [], {"traj_speed": ("traj_flat", 3, 1)}, ranges={"traj_speed": (-1e18, 10.0)}, scales={"traj_speed": 30.0})
    return pairs.unionByName(speeds).select(
        "name", "n", "n_nan", "n_inf", "n_valid", "n_outside", *[r(c, 4).alias(c) for c in ("min", "max", "mean", "max_abs", "p99")]
    )


MD5 = "md5(concat_ws('|', '42', vehicle_id, trip_no, p_pos, f_pos))"


@query(
    "sample_pairs",
    sql(
        f"""select vehicle_id, trip_no, p_pos, f_pos, observed_eta_s from (select *, row_number() over (partition by vehicle_id, trip_no order by {MD5}, vehicle_id, trip_no, p_pos, f_pos) as rn from eta) where rn <= 8""",
        "eta",
    ),
)
def sample_pairs(spark, sf):
    return fx.sample_pairs(eta(spark, sf), 8).select("vehicle_id", "trip_no", "p_pos", "f_pos", "observed_eta_s")


@query(
    "stratified_sample",
    sql(
        f"""select vehicle_id, trip_no, p_pos, f_pos, ramal_id, hour, dow from (select *, row_number() over (partition by ramal_id, hour, dow order by {MD5}, vehicle_id, trip_no, p_pos, f_pos) as rn
        from (select * exclude (dow), cast(dow as integer) as dow, cast(case when round(case when a < 0 then a + 24 else a end) >= 24 then round(case when a < 0 then a + 24 else a end) - 24 else round(case when a < 0 then a + 24 else a end) end as integer) as hour
          from (select *, atan2(cast(cast(hour_sin as float) as double), cast(cast(hour_cos as float) as double))*24/(2*3.14159265) as a from eta))) where rn <= 5""",
        "eta",
    ),
)
def stratified_sample(spark, sf):
    from fleetlens.operators.eta_models import with_hour

    return fx.stratified_sample(with_hour(eta(spark, sf)), 5).select("vehicle_id", "trip_no", "p_pos", "f_pos", "ramal_id", "hour", "dow")


@query("shuffle_rows", sql(f"select vehicle_id, trip_no, p_pos, f_pos, {MD5.replace(chr(39)+'42', chr(39)+'7')} as shuffle_key from eta", "eta"))
def shuffle_rows(spark, sf):
    return fx.shuffle_rows(eta(spark, sf), seed=7).select("vehicle_id", "trip_no", "p_pos", "f_pos", "shuffle_key")
