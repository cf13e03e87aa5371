"""Distances, projections and branch choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import geo
from fleetlens.operators import geometry
from fleetlens.operators.scale import small
from fleetlens.plans import testbed as tb
from fleetlens.plans.oracle import cte, hav, nearest, sql
from fleetlens.plans.registry import query, r, rq
from fleetlens.plans.trip_queries import requests

OBELISK = (-34.6037, -58.3816)


@query("haversine", sql(f"select event_id, {rq(hav('lat', 'lon', '(-34.6037::double)', '(-58.3816::double)'), 'dist_m', 4)} from pings", "pings"))
def haversine(spark, sf):
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(OBELISK[0]), F.lit(OBELISK[1]))
    return tb.pings(spark, sf).select("event_id", r(d, 4).alias("dist_m"))


EQ = "sqrt(pow({a0}-{b0},2) + pow(({a1}-{b1})*cos(radians(({a0}+{b0})/2)),2))*111320.0"


@query(
    "equirectangular",
    sql(f"select event_id, {rq(EQ.format(a0='lat', a1='lon', b0='(-34.6037::double)', b1='(-58.3816::double)'), 'dist_m', 4)} from pings", "pings"),
)
def equirectangular(spark, sf):
    d = geo.equirect_m(F.col("lat"), F.col("lon"), F.lit(OBELISK[0]), F.lit(OBELISK[1]))
    return tb.pings(spark, sf).select("event_id", r(d, 4).alias("dist_m"))


# lengths under both keys, joined to the trips that use them
cte(
    "length_keys",
    """select length_key, max_by(length_m, line || lpad(branch_pos::varchar, 3, '0')) as length_m from (
  select s.shape_id as length_key, l.length_m, s.line, s.branch_pos from lengths l join shapes s using (shape_id)
  union all select s.line || '-' || s.direction, l.length_m, s.line, s.branch_pos from lengths l join shapes s using (shape_id)) group by length_key""",
    "lengths",
    "shapes",
)


@query(
    "shape_lengths",
    sql(
        f"""select length_key, {rq('any_value(length_m)', 'length_m', 4)}, count(*) as n_points from (select vehicle_id, trip_no, shape_id as length_key from proj
        union all select vehicle_id, trip_no, line || '-' || trip_direction_id from proj) join length_keys using (length_key) group by length_key""",
        "proj",
        "length_keys",
    ),
)
def shape_lengths(spark, sf):
    used = tb.projected(spark, sf).groupBy("shape_id", "line", "trip_direction_id").agg(F.count(F.lit(1)).alias("n"))
    keys = F.array("shape_id", F.concat_ws("-", "line", F.col("trip_direction_id").cast("string")))
    return (
        used.select(F.explode(keys).alias("length_key"), "n")
        .groupBy("length_key")
        .agg(F.sum("n").alias("n_points"))
        .join(geometry.shape_lengths(tb.shapes(spark)), "length_key")
        .select("length_key", r("length_m", 4).alias("length_m"), "n_points")
    )


@query(
    "shape_segments",
    sql(
        f"""select s.shape_id, s.seg_no, {rq('any_value(s.ab_x)', 'ab_x', 4)}, {rq('any_value(s.ab_y)', 'ab_y', 4)}, {rq('any_value(s.cum_m)', 'cum_m', 4)},
        {rq('any_value(s.len_m)', 'len_m', 4)}, count(p.event_id) as n_points from segs s left join proj p on p.shape_id = s.shape_id and p.seg_no = s.seg_no group by s.shape_id, s.seg_no""",
        "segs",
        "proj",
    ),
)
def shape_segments(spark, sf):
    segs = geometry.shape_segments(tb.shapes(spark)).select("shape_id", "seg_no", "ab_x", "ab_y", "cum_m", "len_m")
    pts = tb.projected_table(spark, sf).select("shape_id", "event_id", "lat", "lon")
    hit = geometry.project_points(pts, tb.paths(spark), ["shape_id"], segment=True)
    counts = hit.groupBy("shape_id", "seg_no").agg(F.count(F.lit(1)).alias("n_points"))
    return segs.join(counts, ["shape_id", "seg_no"], "left").select(
        "shape_id", "seg_no", r("ab_x", 4).alias("ab_x"), r("ab_y", 4).alias("ab_y"), r("cum_m", 4).alias("cum_m"), r("len_m", 4).alias("len_m"),
        F.coalesce("n_points", F.lit(0)).alias("n_points"),
    )


@query(
    "project_points",
    sql(f"select event_id, shape_id, mapped, {rq('along_m', None, 4)}, {rq('offset_m', None, 4)} from proj_all", "proj_all"),
)
def project_points(spark, sf):
    return tb.projected(spark, sf, near=False).select("event_id", "shape_id", "mapped", r("along_m", 4).alias("along_m"), r("offset_m", 4).alias("offset_m"))


@query(
    "project_trips",
    sql(
        f"select vehicle_id, trip_no, shape_id, count(*) as n_near, {rq('min(along_m)', 'first_m', 4)}, {rq('max(along_m)', 'last_m', 4)} from proj group by all",
        "proj",
    ),
)
def project_trips(spark, sf):
    return (
        tb.projected(spark, sf)
        .groupBy("vehicle_id", "trip_no", "shape_id")
        .agg(F.count(F.lit(1)).alias("n_near"), r(F.min("along_m"), 4).alias("first_m"), r(F.max("along_m"), 4).alias("last_m"))
    )


@query(
    "assign_shape",
    sql("select vehicle_id, trip_no, line, trip_route_id, trip_direction_id, shape_id, mapped from assigned where point_no = 0", "assigned"),
)
def assign_shape(spark, sf):
    return geometry.assign_shape(tb.trip_points(spark, sf).where("point_no = 0"), tb.branch_map(spark), tb.paths(spark)).select(
        "vehicle_id", "trip_no", "line", "trip_route_id", "trip_direction_id", "shape_id", "mapped"
    )


cte("valid_requests", "select request_id as event_id, request_id, lat, lon, line, radius_m, max_results from checked where reason is null", "checked")
cte(
    "request_lines",
    """select request_id * 10 + row_number() over (partition by request_id order by s.line) as event_id, r.request_id, r.lat, r.lon, s.line
  from valid_requests r join (select distinct line from shapes) s on r.line is null or r.line = s.line""",
    "valid_requests",
    "shapes",
)
cte(
    "request_hits",
    nearest("request_lines", "s.shape_id in (select shape_id from shapes x where x.line = p.line)"),
    "request_lines",
    "segs",
    "shapes",
)
cte(
    "request_branch",
    """select * exclude (rn) from (select h.request_id, h.line, h.on_shape as shape_id, s.name, s.direction, h.along_m, h.offset_m,
  row_number() over (partition by h.request_id, h.line order by h.offset_m, s.branch_pos) as rn
  from request_hits h join shapes s on s.shape_id = h.on_shape) where rn = 1 and offset_m <= 150""",
    "request_hits",
    "shapes",
)


def request_branches(spark, sf):
    from fleetlens.operators.arrivals import request_lines
    from fleetlens.operators.filters import valid_requests, validate_requests

    asked = request_lines(valid_requests(validate_requests(requests(spark, sf))), tb.shapes(spark))
    return geometry.best_branch(asked, tb.paths(spark), ["request_id"])


@query(
    "best_branch",
    sql(f"select request_id, line, shape_id, name, direction, {rq('along_m', None, 4)}, {rq('offset_m', None, 4)} from request_branch", "request_branch"),
)
def best_branch(spark, sf):
    return request_branches(spark, sf).select(
        "request_id", "line", "shape_id", "name", "direction", r("along_m", 4).alias("along_m"), r("offset_m", 4).alias("offset_m")
    )


cte(
    "fleet_near",
    """select * from (""" + nearest("latest", "s.shape_id in (select shape_id from shapes x where x.line = p.line)") + """) where offset_m <= 150""",
    "latest",
    "segs",
    "shapes",
)


@query(
    "project_fleet",
    sql(f"select vehicle_id, line, on_shape as shape_id, {rq('along_m', None, 4)} from fleet_near", "fleet_near"),
)
def project_fleet(spark, sf):
    from fleetlens.plans.trip_queries import latest

    p = tb.paths(spark)
    return geometry.project_fleet(latest(spark, sf), p, p).select("vehicle_id", "line", "shape_id", r("along_m", 4).alias("along_m"))


cte(
    "candidate_hits",
    nearest("points", "s.shape_id in (select shape_id from shapes x where x.line = p.line and x.direction = p.trip_direction_id)"),
    "points",
    "segs",
    "shapes",
)
cte(
    "trip_branch",
    """select * exclude (rn) from (select *, row_number() over (partition by vehicle_id, trip_no order by n_near desc, branch_pos) as rn from (
  select h.vehicle_id, h.trip_no, h.on_shape as shape_id, s.branch_pos, count(*) as n_near, max(h.along_m) - min(h.along_m) as span_m
  from candidate_hits h join shapes s on s.shape_id = h.on_shape where h.offset_m < 150 group by all)) where rn = 1 and n_near >= 3 and span_m >= 200""",
    "candidate_hits",
    "shapes",
)


@query("best_branch_per_trip", sql(f"select vehicle_id, trip_no, shape_id, n_near, {rq('span_m', None, 4)} from trip_branch", "trip_branch"))
def best_branch_per_trip(spark, sf):
    return geometry.best_branch_per_trip(tb.trip_points(spark, sf), tb.paths(spark)).select(
        "vehicle_id", "trip_no", "shape_id", "n_near", r("span_m", 4).alias("span_m")
    )


@query(
    "shape_for_direction",
    sql(
        """select p.event_id, s.shape_id from points p join (select line, direction, min_by(shape_id, branch_pos) as shape_id from shapes group by all) s
        on s.line = p.line and s.direction = p.trip_direction_id""",
        "points",
        "shapes",
    ),
)
def shape_for_direction(spark, sf):
    first = geometry.shape_for(tb.shapes(spark)).select("line", F.col("direction").alias("trip_direction_id"), "shape_id")
    return tb.trip_points(spark, sf).join(small(first), ["line", "trip_direction_id"]).select("event_id", "shape_id")


cte(
    "entries",
    """select s.*, row_number() over (partition by s.line, s.short_name order by s.branch_pos) - 1 as entry_direction, f.parent, f.parent is not null as is_short_turn,
  s.short_name || '-d' || (row_number() over (partition by s.line, s.short_name order by s.branch_pos) - 1) as shape_key
  from shapes s left join families f on f.line = s.line and f.child = s.short_name""",
    "shapes",
    "families",
)


@query(
    "branch_entries",
    sql(
        """select e.line, e.shape_key, e.shape_id, cast(e.entry_direction as integer) as entry_direction, e.is_short_turn, e.parent, count(a.event_id) as n_points
        from entries e left join assigned a on a.shape_id = e.shape_id group by all""",
        "entries",
        "assigned",
    ),
)
def branch_entries(spark, sf):
    used = (
        geometry.assign_shape(tb.trip_points(spark, sf), tb.branch_map(spark), tb.paths(spark))
        .groupBy("shape_id")
        .agg(F.count(F.lit(1)).alias("n_points"))
    )
    return (
        geometry.branch_entries(tb.shapes(spark), tb.families(spark))
        .join(used, "shape_id", "left")
        .select("line", "shape_key", "shape_id", "entry_direction", "is_short_turn", "parent", F.coalesce("n_points", F.lit(0)).alias("n_points"))
    )


cte(
    "quality_src",
    """select * from (""" + nearest("points", "s.shape_id = (select min_by(shape_id, branch_pos) from shapes x where x.line = p.line and x.direction = p.trip_direction_id)") + ")",
    "points",
    "segs",
    "shapes",
)


@query(
    "projection_quality",
    sql(
        f"""select line, count(distinct vehicle_id) as n_vehicles, count(*) as n_points, {rq('(list(offset_m order by offset_m))[cast(floor(count(*)*0.5) as bigint)+1]', 'p50_m', 4)},
        {rq('(list(offset_m order by offset_m))[cast(floor(count(*)*0.9) as bigint)+1]', 'p90_m', 4)}, {rq('100.0*sum(case when offset_m > 150 then 1 else 0 end)/count(*)', 'pct_over_150', 4)},
        (list(offset_m order by offset_m))[cast(floor(count(*)*0.9) as bigint)+1] <= 150 as ok from quality_src group by line""",
        "quality_src",
    ),
)
def projection_quality(spark, sf):
    first = geometry.shape_for(tb.shapes(spark)).select("line", F.col("direction").alias("trip_direction_id"), "shape_id")
    pts = tb.trip_points(spark, sf).join(small(first), ["line", "trip_direction_id"])
    q = geometry.projection_quality(geometry.project_points(pts, tb.paths(spark), ["shape_id"]), ["line"])
    return q.select("line", "n_vehicles", "n_points", r("p50_m", 4).alias("p50_m"), r("p90_m", 4).alias("p90_m"), r("pct_over_150", 4).alias("pct_over_150"), "ok")


# a shape per vehicle, following its pings; stops at every third point
def own_shapes(spark, sf):
    """One synthetic branch per (vehicle, hour) following its pings, with a stop at every third vertex."""
    p = tb.lined_pings(spark, sf).where("line is not null")
    vertex = F.struct("ts", "event_id", "lat", "lon")
    # a vertex list spans one hour of one vehicle, at most 3,600 distinct seconds
    hours = p.groupBy("line", "vehicle_id", F.expr("ts div 3600").alias("h")).agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    pts = F.transform("v", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    stops = F.filter(
        F.transform(
            "v",
            lambda x, i: F.struct(
                F.concat(F.lit("s"), i.cast("string")).alias("id"),
                F.when(i % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("Stop "), i.cast("string"))).alias("name"),
                x["lat"].alias("lat"),
                x["lon"].alias("lng"),
                i.alias("i"),
            ),
        ),
        lambda s: s["i"] % 3 == 0,
    )
    return hours.select(
        "line",
        F.concat(F.lit("#"), F.upper(F.hex(F.col("h"))), F.lit("Ab")).alias("color"),
        F.col("h").cast("int").alias("branch_pos"),
        F.concat_ws("-", "vehicle_id", "h").alias("shape_id"),
        F.concat("line", F.lit("A")).alias("short_name"),
        F.concat(F.lit("Barracas → "), "vehicle_id").alias("name"),
        F.lit(None).cast("int").alias("direction"),
        pts.alias("points"),
        F.transform(stops, lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"), s["lat"].alias("lat"), s["lng"].alias("lng"))).alias("stops"),
    )


cte(
    "own_vertices",
    """select line, vehicle_id, ts // 3600 as h, vehicle_id || '-' || (ts // 3600) as shape_id, row_number() over w - 1 as i, count(*) over (partition by line, vehicle_id, ts // 3600) as n, lat, lon
  from lined where line is not null window w as (partition by line, vehicle_id, ts // 3600 order by ts, event_id, lat, lon)""",
    "lined",
)


@query(
    "shape_stats",
    sql(
        """select line, shape_id, lower(to_hex(h)) || 'ab' as color, count(*) as n_points, cast(sum(case when i % 3 = 0 then 1 else 0 end) as bigint) as n_stops,
        cast(sum(case when i % 3 = 0 and i % 6 <> 0 then 1 else 0 end) as bigint) as n_named from own_vertices group by line, shape_id, h""",
        "own_vertices",
    ),
)
def shape_stats(spark, sf):
    s = geometry.shape_stats(own_shapes(spark, sf))
    return s.select("line", "shape_id", "color", *[F.col(c).cast("long").alias(c) for c in ("n_points", "n_stops", "n_named")])


@query(
    "truncate_shapes",
    sql(
        f"""select shape_id, short_name, name, count(*) as n_points, cast(sum(case when i % 3 = 0 then 1 else 0 end) as bigint) as n_stops, {rq('sum(lat)', 'lat_sum', 8)}, {rq('sum(lon * (rn + 1))', 'lon_check', 8)} from (
        select *, row_number() over (partition by shape_id order by i) - 1 as rn from (
        select v.shape_id, v.line || 'A' as short_name, 'Barracas → ' || v.vehicle_id as name, v.i, v.lat, v.lon from own_vertices v
        union all
        select 'frac_' || v.shape_id, v.line || 'D', 'Constitución → ' || v.vehicle_id, v.i, v.lat, v.lon from own_vertices v where v.i >= 3))
        group by shape_id, short_name, name""",
        "own_vertices",
    ),
)
def truncate_shapes(spark, sf):
    s = own_shapes(spark, sf)
    rules = s.select(
        F.col("shape_id").alias("base_shape"),
        F.concat("line", F.lit("D")).alias("short_name"),
        F.lit("tail").alias("keep"),
        F.lit("s3").alias("stop_id"),
        F.lit("Barracas →").alias("find"),
        F.lit("Constitución →").alias("replace"),
    )
    out = geometry.truncate_shapes(s, rules)
    # positions of the vertices inside the full shape are not kept, so stops are counted on the cut list
    return out.select(
        "shape_id",
        "short_name",
        "name",
        F.size("points").cast("long").alias("n_points"),
        F.size("stops").cast("long").alias("n_stops"),
        r(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lat"]), 8).alias("lat_sum"),
        r(F.aggregate(F.transform("points", lambda p, i: p["lon"] * (i + 1)), F.lit(0.0), lambda a, x: a + x), 8).alias("lon_check"),
    )


@query(
    "line_stats",
    sql(
        "select line, count(distinct shape_id) as n_branches, count(*) as n_points, cast(sum(case when i % 3 = 0 then 1 else 0 end) as bigint) as n_stops from own_vertices group by line",
        "own_vertices",
    ),
)
def line_stats(spark, sf):
    return geometry.line_stats(geometry.shape_stats(own_shapes(spark, sf)))
