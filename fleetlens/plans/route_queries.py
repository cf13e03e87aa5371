"""Branch resolution and route-id life cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import branches as br
from fleetlens.operators import route_ids as ri
from fleetlens.plans import testbed as tb
from fleetlens.plans.oracle import cte, sql
from fleetlens.plans.registry import query, r, rq

# looser than the defaults: the test path scatters by up to 178 m
LOOSE = {"containment_min": 0.5, "vote_margin": 0.15, "quantile_margin": 0.05, "coverage_gap": 0.15, "short_turn_margin": 0.05, "min_trips": 3}
CONTAINED_M = 100.0


@query(
    "scan_route_ids",
    sql("select day, line, route_id, min_by(direction_id, ts*1000000 + event_id) as direction_id from lined where line is not null group by all", "lined"),
)
def scan_route_ids(spark, sf):
    return br.scan_route_ids(tb.lined_pings(spark, sf))


cte("trip_days", "select line, trip_route_id as route_id, vehicle_id, trip_no, trip_direction_id as direction_id, trip_start_ts, n_points, day as trip_day from points where point_no = 0 and line is not null", "points")
cte(
    "evidence",
    """select line, route_id, count(*) as n_trips, cast(sum(n_points) as bigint) as n_points, arg_max(direction_id, (trip_start_ts, vehicle_id, trip_no)) as direction_id,
  min(trip_day) as first_day, max(trip_day) as last_day from trip_days group by all""",
    "trip_days",
)


@query("route_evidence", sql("select line, route_id, n_trips, n_points, direction_id, first_day, last_day from evidence", "evidence"))
def route_evidence(spark, sf):
    return br.route_evidence(br.trip_days(tb.trip_points_table(spark, sf)))


cte(
    "cand",
    """select h.line, h.trip_route_id as route_id, h.vehicle_id, h.trip_no, h.event_id, e.shape_key, h.offset_m, h.along_m,
  min(h.offset_m) over (partition by h.event_id) as best from candidate_hits h join entries e on e.shape_id = h.on_shape""",
    "candidate_hits",
    "entries",
)
cte(
    "votes",
    """select *, case when offset_m <= best + 3 then 1.0/sum(case when offset_m <= best + 3 then 1 else 0 end) over (partition by event_id) else 0.0 end as vote,
  case when offset_m < 100 then 1.0 else 0.0 end as contained from cand""",
    "cand",
)


def evidence(spark, sf):
    return br.route_evidence(br.trip_days(tb.trip_points_table(spark, sf)))


def cands(spark):
    return br.candidates(tb.shapes(spark), tb.families(spark))


def projection(spark, sf):
    return tb.stage(
        spark,
        sf,
        "candidate_projection",
        lambda: br.candidate_projection(tb.trip_points_table(spark, sf), evidence(spark, sf), cands(spark), contained_m=CONTAINED_M),
    )


@query(
    "candidate_projection",
    sql(
        f"""select line, route_id, shape_key, count(*) as n, {rq('sum(offset_m)', 'offset_sum', 3)}, {rq('sum(along_m)', 'along_sum', 3)} from votes group by all""",
        "votes",
    ),
)
def candidate_projection(spark, sf):
    p = br.candidate_projection(tb.trip_points_table(spark, sf), evidence(spark, sf), cands(spark), contained_m=CONTAINED_M)
    return p.groupBy("line", "route_id", "shape_key").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("offset_m"), 3).alias("offset_sum"), r(F.sum("along_m"), 3).alias("along_sum")
    )


@query("vote_fractions", sql(f"select line, route_id, shape_key, {rq('sum(vote)/count(*)', 'vote_frac')} from votes group by all", "votes"))
def vote_fractions(spark, sf):
    return br.vote_fractions(projection(spark, sf)).withColumn("vote_frac", r("vote_frac"))


@query("containment", sql(f"select line, route_id, shape_key, {rq('avg(contained)', 'containment')} from votes group by all", "votes"))
def containment(spark, sf):
    return br.containment(projection(spark, sf)).withColumn("containment", r("containment"))


@query(
    "coverage",
    sql(
        f"""select v.line, v.route_id, v.shape_key, {rq('(quantile_cont(v.along_m, 0.98) - quantile_cont(v.along_m, 0.02))/any_value(p.planar_m)', 'coverage')} from votes v
        join entries e on e.line = v.line and e.shape_key = v.shape_key join planar p on p.shape_id = e.shape_id group by all""",
        "votes",
        "entries",
        "planar",
    ),
)
def coverage(spark, sf):
    return br.coverage(projection(spark, sf), br.branch_lengths(cands(spark))).withColumn("coverage", r("coverage"))


@query("error_quantile", sql(f"select line, route_id, shape_key, {rq('quantile_cont(offset_m, 0.95)', 'q_high_m', 4)} from votes group by all", "votes"))
def error_quantile(spark, sf):
    return br.error_quantile(projection(spark, sf)).withColumn("q_high_m", r("q_high_m", 4))


cte(
    "scores",
    """select v.line, v.route_id, v.shape_key, any_value(e.branch_pos) as branch_pos, any_value(e.shape_id) as shape_id, any_value(e.short_name) as short_name,
  any_value(e.is_short_turn) as is_short_turn, any_value(e.parent) as parent, any_value(e.entry_direction) as entry_direction, sum(vote)/count(*) as vote_frac, avg(contained) as containment,
  (quantile_cont(along_m, 0.98) - quantile_cont(along_m, 0.02))/any_value(p.planar_m) as coverage, quantile_cont(offset_m, 0.95) as q_high
  from votes v join entries e on e.line = v.line and e.shape_key = v.shape_key join planar p on p.shape_id = e.shape_id group by all""",
    "votes",
    "entries",
    "planar",
)


def scores(spark, sf):
    return br.candidate_scores(projection(spark, sf), cands(spark))


@query(
    "top_candidates",
    sql(
        f"""select line, route_id, cast(row_number() over (partition by line, route_id order by round(q_high, 1), branch_pos) as integer) as place, shape_key as key,
        {rq('q_high', 'q_high_m', 1)}, {rq('containment', None, 3)}, {rq('coverage', None, 3)}, {rq('vote_frac', None, 3)} from scores""",
        "scores",
    ),
)
def top_candidates(spark, sf):
    t = br.top_candidates(scores(spark, sf))
    return t.select("line", "route_id", F.posexplode("top_candidates").alias("place", "c")).select(
        "line", "route_id", (F.col("place") + 1).alias("place"), "c.key", *[(F.col(f"c.{x}") + F.lit(0.0)).alias(x) for x in ("q_high_m", "containment", "coverage", "vote_frac")]
    )


def decision_ctes(prefix: str, scores_cte: str, evidence_cte: str, keys: str) -> None:
    """CTEs <prefix>_high … <prefix>_verdict for the decision over ``keys`` (comma separated)."""
    on = " and ".join(f"{{a}}.{k} = {{b}}.{k}" for k in keys.split(", "))
    cte(f"{prefix}_high", f"""select *, coverage*containment as score, row_number() over (partition by {keys} order by coverage*containment desc, branch_pos) as rc,
      row_number() over (partition by {keys} order by vote_frac desc, branch_pos) as rv, row_number() over (partition by {keys} order by q_high, branch_pos) as rqq
      from {scores_cte} where containment >= {LOOSE['containment_min']}""", scores_cte)
    cte(f"{prefix}_facts", f"""select e.*, w.shape_key as w_key, w.shape_id as w_id, w.is_short_turn as short, w.coverage as w_cov, w.containment as w_cont, w.vote_frac as w_vote, w.score as w_score,
      coalesce(pa.coverage, 0.0) as parent_cov, rv.second as rival, v1.shape_key as v_key, v1.shape_id as v_id, v1.vote_frac - coalesce(v2.vote_frac, 0.0) as vm, q1.shape_key as q_key, q1.shape_id as q_id, q1.q_high as q_best,
      case when coalesce(q2.q_high, q1.q_high) > 0 then (coalesce(q2.q_high, q1.q_high) - q1.q_high)/coalesce(q2.q_high, q1.q_high) else 0.0 end as qm
      from {evidence_cte} e left join {prefix}_high w on {on.format(a='w', b='e')} and w.rc = 1 left join {prefix}_high v1 on {on.format(a='v1', b='e')} and v1.rv = 1
      left join {prefix}_high v2 on {on.format(a='v2', b='e')} and v2.rv = 2 left join {prefix}_high q1 on {on.format(a='q1', b='e')} and q1.rqq = 1
      left join {prefix}_high q2 on {on.format(a='q2', b='e')} and q2.rqq = 2
      left join {scores_cte} pa on {on.format(a='pa', b='e')} and pa.short_name = w.parent
      left join (select {keys}, max(score) as second from {prefix}_high where is_short_turn and rc > 1 group by {keys}) rv on {on.format(a='rv', b='e')}""",
      f"{prefix}_high", scores_cte, evidence_cte)
    cte(f"{prefix}_margins", f"""select *, case when rival is null then 1.0 when w_score > 0 then (w_score - rival)/w_score else 0.0 end as family_margin,
      case when w_cov > 0 then (w_cov - parent_cov)/w_cov else 0.0 end as gap, vm >= {LOOSE['vote_margin']} as vote_ok, qm >= {LOOSE['quantile_margin']} as q_ok from {prefix}_facts""", f"{prefix}_facts")
    cte(f"{prefix}_verdict", f"""select *, case when reason is not null then null when short then w_key when vote_ok and v_key = q_key then v_key when q_ok then q_key else v_key end as shape_key,
      case when reason is not null then null when short then 'coverage_gap' else concat_ws('+', case when vote_ok then 'vote' end, case when q_ok then 'q95' end,
        case when (case when vote_ok and v_key = q_key then v_key when q_ok then q_key else v_key end) = w_key then 'cov' end) end as method,
      case when reason is not null then 0.0 when short then gap else greatest(vm, qm) end as confidence
      from (select *, case when n_trips < {LOOSE['min_trips']} then 'cold_start' when not exists (select 1 from entries n where n.line = m.line and n.entry_direction = m.direction_id) then 'no_shapes_for_direction' when w_key is null then 'no_high_containment'
        when short and family_margin < {LOOSE['short_turn_margin']} then 'ambiguous_fraccionado_family' when short and gap < {LOOSE['coverage_gap']} then 'ambiguous_fraccionado'
        when not short and not vote_ok and not q_ok then 'ambiguous_completo' end as reason from {prefix}_margins m)""", f"{prefix}_margins", "entries")


decision_ctes("dec", "scores", "evidence", "line, route_id")


def verdicts(spark, sf):
    c = cands(spark)
    return br.resolve_routes(evidence(spark, sf), scores(spark, sf), c, **LOOSE)


@query(
    "resolve_routes",
    sql(
        f"""select line, route_id, direction_id, case when reason is null then 'resolved' else 'pending' end as status, reason, shape_key, case when reason is null then case when short then 'fraccionado' else 'completo' end end as assignment_type,
        method, {rq('confidence')}, n_trips as total_trips, n_points as total_points, {rq("case when reason is null and short then w_vote when (reason is null or reason like 'ambiguous%') and not short then vm else 0.0 end", 'vote_margin')},
        {rq("case when (reason is null or reason like 'ambiguous%') and not short then qm else 0.0 end", 'quantile_margin')}, {rq("case when reason is null then w_cov else 0.0 end", 'coverage_winner_val')} from dec_verdict""",
        "dec_verdict",
    ),
)
def resolve_routes(spark, sf):
    v = verdicts(spark, sf)
    return v.select(
        "line", "route_id", "direction_id", "status", "reason", "shape_key", "assignment_type", "method", "total_trips", "total_points",
        *[r(c).alias(c) for c in ("confidence", "vote_margin", "quantile_margin", "coverage_winner_val")],
    )


@query(
    "resolution_summary",
    sql(
        """select line, 'total' as section, '' as key, '' as detail, count(*) as n, 100.0::double as pct from dec_verdict group by line
        union all select line, 'resolved', '', '', sum(case when reason is null then 1 else 0 end)::bigint, round(100.0*sum(case when reason is null then 1 else 0 end)/count(*), 1) from dec_verdict group by line
        union all select line, 'branch', shape_key, case when short then 'fraccionado' else 'completo' end || ':' || method, count(*), null from dec_verdict where reason is null group by all
        union all select line, 'pending', reason, '', count(*), null from dec_verdict where reason is not null group by all
        union all select line, 'uncovered', shape_key, '', 1, null from entries e where not exists (select 1 from dec_verdict d where d.line = e.line and d.shape_key = e.shape_key)""",
        "dec_verdict",
        "entries",
    ),
)
def resolution_summary(spark, sf):
    v = tb.stored(verdicts(spark, sf), "verdicts")
    return br.resolution_summary(v, cands(spark))


cte("day_nos", "select day as trip_day, row_number() over (order by day) as day_no, count(*) over () as n_days from (select distinct day from pings)", "pings")
cte("route_days", "select distinct t.line, t.route_id, d.day_no from trip_days t join day_nos d using (trip_day)", "trip_days", "day_nos")
cte(
    "spans",
    """select line, route_id, min(day_no) as first_no, max(day_no) as last_no, coalesce(min(case when gone then day_no end), max(day_no)) as until_no, bool_or(gone) as retires, bool_or(day_no = n_days) as on_last_day
  from (select *, coalesce(lead(day_no) over (partition by line, route_id order by day_no), n_days + 1) - day_no - 1 >= 7 as gone from route_days, (select max(day_no) as n_days from day_nos)) group by all""",
    "route_days",
    "day_nos",
)
cte(
    "openings",
    "select t.line, t.route_id, arg_max(t.direction_id, (t.trip_start_ts, t.vehicle_id, t.trip_no)) as direction_id from trip_days t join day_nos d using (trip_day) join spans s using (line, route_id) where d.day_no = s.first_no group by all",
    "trip_days",
    "day_nos",
    "spans",
)
cte(
    "used_trips",
    "select t.*, d.day_no from trip_days t join day_nos d using (trip_day) join spans s using (line, route_id) where d.day_no > s.first_no and d.day_no <= s.until_no",
    "trip_days",
    "day_nos",
    "spans",
)
cte(
    "asof_evidence",
    """select a.line, a.route_id, a.day_no, o.direction_id, count(*) as n_trips, sum(u.n_points) as n_points from (select distinct line, route_id, day_no from used_trips) a
  join used_trips u on u.line = a.line and u.route_id = a.route_id and u.day_no <= a.day_no join openings o on o.line = a.line and o.route_id = a.route_id group by all""",
    "used_trips",
    "openings",
)
cte(
    "asof_scores",
    """select a.line, a.route_id, a.day_no, v.shape_key, any_value(e.branch_pos) as branch_pos, any_value(e.shape_id) as shape_id, any_value(e.short_name) as short_name, any_value(e.is_short_turn) as is_short_turn,
  any_value(e.parent) as parent, sum(vote)/count(*) as vote_frac, avg(contained) as containment, (quantile_cont(along_m, 0.98) - quantile_cont(along_m, 0.02))/any_value(p.planar_m) as coverage, quantile_cont(offset_m, 0.95) as q_high
  from (select distinct line, route_id, day_no from used_trips) a join used_trips u on u.line = a.line and u.route_id = a.route_id and u.day_no <= a.day_no
  join votes v on v.vehicle_id = u.vehicle_id and v.trip_no = u.trip_no join entries e on e.line = v.line and e.shape_key = v.shape_key join planar p on p.shape_id = e.shape_id group by a.line, a.route_id, a.day_no, v.shape_key""",
    "used_trips",
    "votes",
    "entries",
    "planar",
)
decision_ctes("life", "asof_scores", "asof_evidence", "line, route_id, day_no")
cte("solved", "select line, route_id, min(day_no) as resolved_no, arg_min(shape_key, day_no) as shape_key, arg_min(method, day_no) as method, arg_min(confidence, day_no) as confidence from life_verdict where reason is null group by all", "life_verdict")


@query(
    "resolve_lifecycle",
    sql(
        f"""select s.line, s.route_id, o.direction_id, f.trip_day as first_seen, l.trip_day as last_seen, rr.trip_day as resolved_on,
        case when (x.resolved_no is not null or not s.retires) and s.on_last_day then 'active' else 'retired' end as status,
        case when x.resolved_no is not null then 'resolved' when s.retires then 'unresolved' else 'pending' end as assignment_status, x.shape_key, x.method, {rq('x.confidence', 'confidence')}
        from spans s join openings o using (line, route_id) left join solved x using (line, route_id) join day_nos f on f.day_no = s.first_no
        join day_nos l on l.day_no = case when x.resolved_no is not null then s.last_no else s.until_no end left join day_nos rr on rr.day_no = x.resolved_no""",
        "spans",
        "openings",
        "solved",
        "day_nos",
    ),
)
def resolve_lifecycle(spark, sf):
    from fleetlens.operators.temporal import ranked_days

    days = ranked_days(tb.pings(spark, sf)).select(F.col("day").alias("trip_day"), "day_no")
    out = br.resolve_lifecycle(tb.trip_points_table(spark, sf), days, tb.shapes(spark), tb.families(spark), tb.stored, contained_m=CONTAINED_M, **LOOSE)
    return out.select(
        "line", "route_id", "direction_id", "first_seen", "last_seen", "resolved_on", "status", "assignment_status", "shape_key", "method", r("confidence").alias("confidence")
    )


# rarer ids than the testbed's twelve: one per (route, event type hash), so ids come and go
cte(
    "rid_obs",
    "select day, line, cast(1300 + (event_id * 7919 % 997) % 120 + case when event_id * 31 % 101 < 20 then (extract(day from cast(day as date)) // 5) * 100 else 0 end as varchar) as route_id, cast(event_id % 2 as integer) as direction_id, ts, event_id from lined where line is not null",
    "lined",
)


def rid_obs(spark, sf):
    e = F.col("event_id")
    extra = F.when(e * 31 % 101 < 20, F.expr("(day(to_date(day)) div 5) * 100")).otherwise(0)
    return tb.lined_pings(spark, sf).where("line is not null").select(
        "day", "line", (F.lit(1300) + (e * 7919 % 997) % 120 + extra).cast("string").alias("route_id"), (e % 2).cast("int").alias("direction_id"), "ts", "event_id"
    )


cte(
    "rid_life",
    """select line, route_id, list_sort(list(distinct direction_id)) as dirs, min(day) as first_seen, max(day) as last_seen, count(distinct day) as days_active, count(*) as obs_count from rid_obs group by all""",
    "rid_obs",
)


@query("route_lifecycle", sql("select line, route_id, array_to_string(dirs, ',') as direction_ids, first_seen, last_seen, days_active, obs_count from rid_life", "rid_life"))
def route_lifecycle(spark, sf):
    out = ri.route_lifecycle(rid_obs(spark, sf))
    return out.withColumn("direction_ids", F.concat_ws(",", F.transform("direction_ids", lambda d: d.cast("string"))))


@query(
    "route_daily",
    sql(
        "select o.line, o.day, count(distinct o.route_id) as n_active, count(distinct case when l.first_seen = o.day then o.route_id end) as n_new from rid_obs o join rid_life l using (line, route_id) group by all",
        "rid_obs",
        "rid_life",
    ),
)
def route_daily(spark, sf):
    return ri.route_daily(rid_obs(spark, sf))


cte(
    "rotations",
    "select line, first_seen as day, count(*) as n_new from rid_life where first_seen <> (select min(day) from rid_obs) group by all having count(*) >= 3",
    "rid_life",
    "rid_obs",
)


def first_day(obs):
    return obs.agg(F.min("day").alias("day"))


@query(
    "rotation_events",
    sql(
        """select r.line, r.day, r.n_new, cast(coalesce(sum(case when l.last_seen < r.day then 1 else 0 end), 0) as bigint) as n_gone, cast(coalesce(sum(case when l.last_seen >= r.day then 1 else 0 end), 0) as bigint) as n_still_active,
        cast(coalesce(max(case when l.last_seen >= r.day then date_diff('day', cast(r.day as date), cast(l.last_seen as date)) else 0 end), 0) as integer) as max_overlap_days
        from rotations r left join rid_life l on l.line = r.line and l.first_seen < r.day group by r.line, r.day, r.n_new""",
        "rotations",
        "rid_life",
    ),
)
def rotation_events(spark, sf):
    obs = rid_obs(spark, sf)
    return ri.rotation_events(ri.route_lifecycle(obs), first_day(obs))


@query(
    "rotation_members",
    sql(
        "select r.line, r.day, l.route_id, case when l.first_seen = r.day then 'new' when l.last_seen >= r.day then 'still_active' else 'gone' end as role from rotations r join rid_life l on l.line = r.line and l.first_seen <= r.day",
        "rotations",
        "rid_life",
    ),
)
def rotation_members(spark, sf):
    obs = rid_obs(spark, sf)
    life = ri.route_lifecycle(obs)
    return ri.rotation_members(life, ri.rotation_events(life, first_day(obs)))


@query(
    "reappearances",
    sql(
        """select line, route_id, array_to_string(l.dirs, ',') as direction_ids, disappeared_after, day as reappeared_on, cast(date_diff('day', cast(disappeared_after as date), cast(day as date)) as integer) as gap_days from (
        select *, lag(day) over (partition by line, route_id order by day) as disappeared_after from (select distinct line, route_id, day from rid_obs)) join rid_life l using (line, route_id)
        where date_diff('day', cast(disappeared_after as date), cast(day as date)) > 5""",
        "rid_obs",
        "rid_life",
    ),
)
def reappearances(spark, sf):
    out = ri.reappearances(rid_obs(spark, sf))
    named = F.concat_ws(",", F.transform("direction_ids", lambda d: d.cast("string"))).alias("direction_ids")
    return out.select("line", "route_id", named, "disappeared_after", "reappeared_on", "gap_days")


@query("dual_direction", sql("select line, route_id from rid_life where len(dirs) > 1", "rid_life"))
def dual_direction(spark, sf):
    return ri.dual_direction(ri.route_lifecycle(rid_obs(spark, sf)))


# lines leave the feed one after the other; what still runs then belongs to another line
cte("fading", "select * replace (case when day <= case line when '39' then '2024-01-30' when '42' then '2024-01-27' when '26' then '2024-01-12' else '2024-01-29' end then line else 'late' end as line) from rid_obs", "rid_obs")


@query(
    "line_last_seen",
    sql(
        """select line, last_seen, case when last_seen < e then strftime(cast(last_seen as date) + 1, '%Y-%m-%d') end as first_not_seen,
        case when last_seen = e then 'still active' when date_diff('day', cast(last_seen as date), cast(e as date)) <= 7 then 'cutoff within recent window' else 'gone' end as note
        from (select line, max(day) as last_seen from fading group by line), (select max(day) as e from fading)""",
        "fading",
    ),
)
def line_last_seen(spark, sf):
    end = F.when(F.col("line") == "39", "2024-01-30").when(F.col("line") == "42", "2024-01-27").when(F.col("line") == "26", "2024-01-12").otherwise("2024-01-29")
    return ri.line_last_seen(rid_obs(spark, sf).withColumn("line", F.when(F.col("day") <= end, F.col("line")).otherwise("late")))


@query(
    "id_pairs",
    sql(
        """select a.line, cast(a.route_id as bigint) as route_id, cast(b.route_id as bigint) as next_id, len(a.dirs) = 1 and len(b.dirs) = 1 and a.dirs[1] <> b.dirs[1] as opposite
        from rid_life a join rid_life b on a.line = b.line and cast(b.route_id as bigint) = cast(a.route_id as bigint) + 1 and a.first_seen <= b.last_seen and b.first_seen <= a.last_seen""",
        "rid_life",
    ),
)
def id_pairs(spark, sf):
    return ri.id_pairs(ri.route_lifecycle(rid_obs(spark, sf)))


@query(
    "direction_symmetry",
    sql(
        """select line, cast(floor(date_diff('day', date '1970-01-01', cast(first_seen as date))/10) as bigint) as period, sum(case when list_contains(dirs, 0) then 1 else 0 end)::bigint as n_dir0,
        sum(case when list_contains(dirs, 1) then 1 else 0 end)::bigint as n_dir1 from rid_life group by all""",
        "rid_life",
    ),
)
def direction_symmetry(spark, sf):
    return ri.direction_symmetry(ri.route_lifecycle(rid_obs(spark, sf)))
