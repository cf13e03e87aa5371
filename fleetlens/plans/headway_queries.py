"""Headways on branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import headway as hw
from fleetlens.plans import testbed as tb
from fleetlens.plans.oracle import cte, sql
from fleetlens.plans.registry import query, r, rq

cte(
    "hpoints",
    """select h.vehicle_id, h.trip_no, b.shape_id, l.length_m, h.event_id, h.ts, h.along_m from candidate_hits h join trip_branch b on b.vehicle_id = h.vehicle_id and b.trip_no = h.trip_no and b.shape_id = h.on_shape
  join lengths l on l.shape_id = b.shape_id where h.offset_m < 150""",
    "candidate_hits",
    "trip_branch",
    "lengths",
)
cte(
    "hpairs",
    "select *, lag(ts) over w as t0, lag(along_m) over w as d0 from hpoints window w as (partition by vehicle_id, trip_no order by ts, event_id)",
    "hpoints",
)


def points(spark, sf):
    return tb.stage(spark, sf, "headway_points", lambda: hw.headway_points(tb.trip_points_table(spark, sf), tb.paths(spark)))


def rounded(df, *ints, digits=4):
    return df.select(*[F.col(c) if c in ints else r(c, digits).alias(c) for c in df.columns])


@query(
    "trip_spans",
    sql(
        f"""select count(*) as n_trips, {rq('quantile_cont(s, 0.5)', 'p50_m', 3)}, {rq('quantile_cont(s, 0.1)', 'p10_m', 3)}, {rq('quantile_cont(s, 0.9)', 'p90_m', 3)} from (
        select max(along_m) - min(along_m) as s from hpoints group by vehicle_id, trip_no)""",
        "hpoints",
    ),
)
def trip_spans(spark, sf):
    return rounded(hw.trip_spans(points(spark, sf)), "n_trips", digits=3)


def quants(col: str, ps: tuple[int, ...]) -> str:
    return ", ".join(rq(f"quantile_cont({col}, {p / 100})", f"p{p}_s", 4) for p in ps)


def shares(items: list[tuple[str, str]]) -> str:
    return ", ".join(rq(f"avg(case when {cond} then 1.0 else 0.0 end)", name, 4) for name, cond in items)


@query(
    "ping_gaps",
    sql(
        f"""select count(*) as n, {rq('avg(dt)', 'mean_s', 4)}, {rq('max(dt)', 'max_s', 4)}, {shares([(f'share_over_{s}s', f'dt > {s}') for s in (60, 120, 300)])}, {quants('dt', (25, 50, 75, 90, 95, 99))}
        from (select ts - t0 as dt from hpairs) where dt > 0 and dt < 3600""",
        "hpairs",
    ),
)
def ping_gaps(spark, sf):
    return rounded(hw.ping_gaps(points(spark, sf)), "n")


cte(
    "targets",
    """select vehicle_id, trip_no, unnest(range(cast(ceil((min(along_m) + 100)/250) as bigint), cast(floor((max(along_m) - 100)/250) as bigint) + 1)) as k from hpoints group by vehicle_id, trip_no""",
    "hpoints",
)


@query(
    "bracket_coverage",
    sql(
        """select state, count(*) as n from (select t.vehicle_id, t.trip_no, t.k, case when bool_or(p.d0 <= t.k*250 and t.k*250 <= p.along_m) then 'bracketed' when min(abs(p.along_m - t.k*250)) <= 250 then 'near' else 'miss' end as state
        from targets t join hpairs p on p.vehicle_id = t.vehicle_id and p.trip_no = t.trip_no group by all) group by state""",
        "targets",
        "hpairs",
    ),
)
def bracket_coverage(spark, sf):
    p = points(spark, sf)
    return hw.bracket_coverage(p, hw.target_grid(p))


cte(
    "passed",
    """select vehicle_id, trip_no, shape_id, checkpoint, passed_at from (select *, row_number() over (partition by vehicle_id, trip_no, checkpoint order by ts, event_id) as rn from (
  select p.*, c.k as checkpoint, t0 + (c.k*500.0 - d0)/(along_m - d0)*(ts - t0) as passed_at from hpairs p join (select unnest(range(1, 200)) as k) c on c.k*500.0 < p.length_m and p.d0 <= c.k*500.0 and c.k*500.0 <= p.along_m and p.along_m > p.d0)) where rn = 1""",
    "hpairs",
)


@query("passages", sql(f"select vehicle_id, trip_no, shape_id, cast(checkpoint as integer) as checkpoint, {rq('passed_at', None, 3)} from passed", "passed"))
def passages(spark, sf):
    return rounded(hw.passages(points(spark, sf)), "vehicle_id", "trip_no", "shape_id", "checkpoint", digits=3)


cte(
    "hw",
    """select shape_id, checkpoint, from_s, headway_s from (select *, lag(passed_at) over w as from_s, passed_at - lag(passed_at) over w as headway_s from passed
  where shape_id in (select shape_id from (select distinct shape_id, vehicle_id, trip_no from hpoints) group by shape_id having count(*) >= 3)
  window w as (partition by shape_id, checkpoint order by passed_at, vehicle_id, trip_no)) where headway_s > 0 and headway_s <= 7200""",
    "passed",
    "hpoints",
)


def headway_rows(spark, sf):
    p = points(spark, sf)
    return hw.headways(tb.stored(hw.passages(p), "passages"), p)


@query("headways", sql(f"select shape_id, cast(checkpoint as integer) as checkpoint, {rq('from_s', None, 3)}, {rq('headway_s', None, 3)} from hw", "hw"))
def headways(spark, sf):
    return rounded(headway_rows(spark, sf), "shape_id", "checkpoint", digits=3)


HS = [("share_under_3min", "headway_s < 180"), ("share_3_10min", "headway_s >= 180 and headway_s < 600"), ("share_over_10min", "headway_s >= 600"), ("share_over_1h", "headway_s > 3600")]


@query(
    "headway_stats",
    sql(
        f"""select scope, count(*) as n, {rq('avg(headway_s)', 'mean_s', 3)}, {rq('max(headway_s)', 'max_s', 3)}, {shares(HS).replace(', 4)', ', 3)')}, {quants('headway_s', (10, 25, 50, 75, 90, 95)).replace(', 4)', ', 3)')}
        from (select 'all' as scope, headway_s from hw union all select case when ((cast(floor(from_s) as bigint) - 10800)//3600) % 24 in (7, 8, 17, 18) then 'peak' else 'off_peak' end, headway_s from hw) group by scope""",
        "hw",
    ),
)
def headway_stats(spark, sf):
    return rounded(hw.headway_stats(tb.stored(headway_rows(spark, sf), "headways")), "scope", "n", digits=3)


@query(
    "interp_error",
    sql(
        f"""select count(*) as n, {rq('avg(e)', 'mean_s', 3)}, {shares([(f'share_under_{s}s', f'e < {s}') for s in (10, 30, 60)]).replace(', 4)', ', 3)')}, {quants('e', (50, 75, 90, 95, 99)).replace(', 4)', ', 3)')} from (
        select abs(t0 + (d1 - d0)/(d2 - d0)*(t2 - t0) - t1) as e from (select lag(along_m, 2) over w as d0, lag(ts, 2) over w as t0, lag(along_m) over w as d1, lag(ts) over w as t1, along_m as d2, ts as t2 from hpoints
        window w as (partition by vehicle_id, trip_no order by ts, event_id)) where d0 < d1 and d1 < d2 and t2 > t0)""",
        "hpoints",
    ),
)
def interp_error(spark, sf):
    return rounded(hw.interp_error(points(spark, sf)), "n", digits=3)
