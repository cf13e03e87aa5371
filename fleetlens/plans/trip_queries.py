"""Filters, line resolution and trip segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import filters, trips
from fleetlens.plans import testbed as tb
from fleetlens.plans.oracle import cte, sql
from fleetlens.plans.registry import query, r, rq

BOX = {"lat_min": -34.6155, "lat_max": -34.606, "lon_min": -58.45, "lon_max": -58.4}
LON_BOX = f"lat between {BOX['lat_min']}::double and {BOX['lat_max']}::double and lon between {BOX['lon_min']}::double and {BOX['lon_max']}::double"


@query("filter_box", sql(f"select event_id, {rq('lat')}, {rq('lon')} from pings where {LON_BOX}", "pings"))
def filter_box(spark, sf):
    return filters.in_box(tb.pings(spark, sf), **BOX).select("event_id", r("lat").alias("lat"), r("lon").alias("lon"))


@query("resolve_line", sql("select event_id, label, line from lined", "lined"))
def resolve_line(spark, sf):
    return tb.lined_pings(spark, sf).select("event_id", "label", "line")


@query(
    "resolve_line_agency",
    sql("select event_id, case when cast(line as integer) <= 100 then line end as line, case when cast(line as integer) <= 100 then agency end as agency from lined", "lined"),
)
def resolve_line_agency(spark, sf):
    return filters.resolve_line_agency(tb.pings(spark, sf), tb.label_map(spark), max_line=100).select("event_id", "line", "agency")


cte("latest", "select * exclude (rn) from (select *, row_number() over (partition by vehicle_id order by ts desc, event_id desc) as rn from lined) where rn = 1", "lined")


def latest(spark, sf):
    """Last ping of every vehicle."""
    p = tb.lined_pings(spark, sf)
    rest = [c for c in p.columns if c != "vehicle_id"]
    return p.groupBy("vehicle_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("v")).select("vehicle_id", "v.*")


@query("vehicles_of_line", sql("select vehicle_id, line, ts from latest where line = '39'", "latest"))
def vehicles_of_line(spark, sf):
    return filters.vehicles_of_line(latest(spark, sf), "39").select("vehicle_id", "line", "ts")


@query(
    "vehicles_of_routes",
    sql("select vehicle_id, route_id, ts from latest where route_id in (select route_id from branch_map where shape_id like '39a%')", "latest", "branch_map"),
)
def vehicles_of_routes(spark, sf):
    routes = tb.branch_map(spark).where("shape_id like '39a%'")
    return filters.vehicles_of_routes(latest(spark, sf), routes).select("vehicle_id", "route_id", "ts")


@query(
    "peak_frames",
    sql("select event_id, raw_epoch from pings where raw_epoch // 3600 % 24 in (13,14,15,16,18,19,21,22,23)", "pings"),
)
def peak_frames(spark, sf):
    return filters.peak_frames(tb.pings(spark, sf), ts="raw_epoch").select("event_id", "raw_epoch")


@query(
    "date_range",
    sql(
        """select strftime(d, '%Y-%m-%d') as day, count(p.event_id) as n from (select unnest(generate_series((select min(day)::date from pings),
        (select max(day)::date from pings), interval 1 day)) as d) left join pings p on p.day = strftime(d, '%Y-%m-%d') group by all""",
        "pings",
    ),
)
def date_range(spark, sf):
    p = tb.pings(spark, sf)
    per_day = p.groupBy(F.to_date("day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = per_day.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    calendar = filters.date_range(spark, *ends)
    return calendar.join(per_day, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


# requests: one per customer, on and off the path, some broken
cte(
    "requests",
    """select c_custkey as request_id, case when c_custkey % 17 = 0 then 0.0::double else -34.619::double + 0.015::double*((c_custkey % 100)/100.0::double) + 0.0005::double*(c_custkey % 5)::double end as lat,
  case when c_custkey % 19 = 0 then -60.0::double else -58.463::double + 0.082::double*((c_custkey % 100)/100.0::double) end as lon,
  case c_custkey % 7 when 0 then null when 1 then '42' when 2 then '26' when 3 then '151' when 4 then 'x9' else '39' end as line,
  case when c_custkey % 11 = 0 then 5000.0::double when c_custkey % 11 = 1 then 250.0::double end as radius_m,
  case when c_custkey % 13 = 0 then 20 when c_custkey % 13 = 1 then 5 end as max_results from customer""",
)
cte(
    "checked",
    """select * exclude (radius_m, max_results), coalesce(radius_m, 300.0::double) as radius_m, coalesce(max_results, 3) as max_results,
  case when not lat between -35.5 and -34.0 then 'lat' when not lon between -59.5 and -57.5 then 'lon'
  when line is not null and not regexp_full_match(line, '\\d{1,4}') then 'line' when not coalesce(radius_m, 300.0) between 50 and 2000 then 'radius_m'
  when not coalesce(max_results, 3) between 1 and 10 then 'max_results' end as reason from requests""",
    "requests",
)


def requests(spark, sf):
    k = F.col("c_custkey")
    step = (k % 100) / F.lit(100.0)
    line = F.when(k % 7 == 1, "42").when(k % 7 == 2, "26").when(k % 7 == 3, "151").when(k % 7 == 4, "x9").when(k % 7 != 0, "39")
    return tb.table(spark, sf, "customer").select(
        k.alias("request_id"),
        F.when(k % 17 == 0, 0.0)
        .otherwise(F.lit(tb.START[0]) + F.lit(tb.SPAN[0]) * step + F.lit(0.0005) * (k % 5).cast("double"))
        .alias("lat"),
        F.when(k % 19 == 0, -60.0).otherwise(F.lit(tb.START[1]) + F.lit(tb.SPAN[1]) * step).alias("lon"),
        line.alias("line"),
        F.when(k % 11 == 0, 5000.0).when(k % 11 == 1, 250.0).alias("radius_m"),
        F.when(k % 13 == 0, 20).when(k % 13 == 1, 5).alias("max_results"),
    )


@query("validate_requests", sql(f"select request_id, {rq('lat')}, {rq('lon')}, line, radius_m, max_results, reason from checked", "checked"))
def validate_requests(spark, sf):
    return filters.validate_requests(requests(spark, sf)).select(
        "request_id", r("lat").alias("lat"), r("lon").alias("lon"), "line", "radius_m", "max_results", "reason"
    )


@query(
    "segment_trips",
    sql("select event_id, vehicle_id, trip_no, point_no, n_points, trip_route_id, trip_direction_id, trip_start_ts from points", "points"),
)
def segment_trips(spark, sf):
    return tb.trip_points(spark, sf).select(
        "event_id", "vehicle_id", "trip_no", "point_no", "n_points", "trip_route_id", "trip_direction_id", "trip_start_ts"
    )


@query(
    "trip_headers",
    sql("select vehicle_id, trip_no, trip_route_id, trip_direction_id, trip_start_ts, n_points from points where point_no = 0", "points"),
)
def trip_headers(spark, sf):
    return trips.trip_headers(tb.trip_points(spark, sf))


@query(
    "trips_by_route",
    sql(
        """select p.vehicle_id, p.trip_no, p.trip_route_id, p.trip_direction_id, p.trip_start_ts, p.n_points, s.line as route_line from points p
        left join branch_map b on b.route_id = p.trip_route_id left join shapes s on s.shape_id = b.shape_id where p.point_no = 0""",
        "points",
        "branch_map",
        "shapes",
    ),
)
def trips_by_route(spark, sf):
    lines = tb.branch_map(spark).select("route_id", "shape_id").join(tb.shapes(spark).select("shape_id", "line"), "shape_id")
    return trips.trips_by_route(tb.trip_points(spark, sf), lines).select(
        "vehicle_id", "trip_no", "trip_route_id", "trip_direction_id", "trip_start_ts", "n_points", "route_line"
    )


@query(
    "trip_summary",
    sql(
        "select vehicle_id, trip_no, trip_route_id, trip_direction_id, trip_start_ts, line, count(*) as n_points from proj group by all",
        "proj",
    ),
)
def trip_summary(spark, sf):
    return trips.trip_summary(tb.projected(spark, sf))


@query(
    "trip_sequence",
    sql(
        """select event_id, vehicle_id, start_date as trip_id, row_number() over w as seq_in_trip, ts - lag(ts) over w as delta_s
        from pings window w as (partition by vehicle_id, start_date order by ts, event_id)""",
        "pings",
    ),
)
def trip_sequence(spark, sf):
    obs = tb.pings(spark, sf).select("event_id", "vehicle_id", F.col("start_date").alias("trip_id"), "ts")
    return trips.trip_sequence(obs).select("event_id", "vehicle_id", "trip_id", "seq_in_trip", "delta_s")
