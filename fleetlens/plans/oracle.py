"""Equivalent ANSI SQL of the registered queries, composed from shared CTEs."""

from __future__ import annotations

from fleetlens.plans import testbed

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (deps, sql)


def sql(select: str, *deps: str) -> str:
    """A statement whose WITH clause lists every CTE it depends on, in order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for d in CTES[name][0]:
            visit(d)
        done.append(name)

    for d in deps:
        visit(d)
    if not done:
        return select
    body = ",\n".join(f"{n} as ({CTES[n][1]})" for n in done)
    word = "with recursive" if any(n.startswith("rec_") for n in done) else "with"
    return f"{word} {body}\n{select}"


def _lit(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _shape_rows() -> str:
    rows = []
    for line, body in testbed.shapes_json().items():
        for pos, b in enumerate(body["ramales"]):
            rows.append(f"({_lit(line)}, {_lit(body['color'])}, {pos}, {_lit(b['shapeId'])}, {_lit(b['shortName'])}, {_lit(b['name'])}, {b['direction']})")
    return ", ".join(rows)


def _vertex_rows() -> str:
    rows = []
    for body in testbed.shapes_json().values():
        for b in body["ramales"]:
            rows += [f"({_lit(b['shapeId'])}, {i}, {p[0]!r}::double, {p[1]!r}::double)" for i, p in enumerate(b["points"])]
    return ", ".join(rows)


def _stop_rows() -> str:
    rows = []
    for body in testbed.shapes_json().values():
        for b in body["ramales"]:
            rows += [
                f"({_lit(b['shapeId'])}, {i}, {_lit(s['id'])}, {_lit(s['name'])}, {s['lat']!r}::double, {s['lng']!r}::double)"
                for i, s in enumerate(b["stops"])
            ]
    return ", ".join(rows)


HAV = (
    "(2*6371000.0*atan2(sqrt(pow(sin(radians({b0}-{a0})/2),2)+cos(radians({a0}))*cos(radians({b0}))*pow(sin(radians({b1}-{a1})/2),2)),"
    "sqrt(1-(pow(sin(radians({b0}-{a0})/2),2)+cos(radians({a0}))*cos(radians({b0}))*pow(sin(radians({b1}-{a1})/2),2)))))"
)


def hav(a0: str, a1: str, b0: str, b1: str) -> str:
    return HAV.format(a0=a0, a1=a1, b0=b0, b1=b1)


cte(
    "pings",
    """select cast(user_id as varchar) as vehicle_id, event_id, raw_epoch, s as ts, s - s % 30 as frame_ts,
  -34.619::double + 0.015::double*((s % 3000)/3000.0::double) + 0.0004::double*(event_id % 9 - 4)::double as lat,
  -58.463::double + 0.082::double*((s % 3000)/3000.0::double) as lon,
  value % 15 as speed, cast(user_id % 2 as integer) as direction_id, cast(1300 + user_id % 12 as varchar) as route_id,
  concat(user_id, '-', user_id % 5) as label, case when extract(day from raw_ts) <= 15 then '20240101' else '20240116' end as start_date,
  '08:00:00' as start_time, strftime(raw_ts, '%Y-%m-%d') as day
from (select event_id, user_id, value, ts as raw_ts, epoch_us(ts)//1000000 as raw_epoch, epoch_us(ts)//1000000//100 as s from events)""",
)
cte(
    "label_map",
    "select * from (values "
    + ", ".join(f"({_lit(s)}, {_lit(line)}, {_lit(a)})" for s, (line, a) in testbed.LABEL_MAP.items() if line)
    + ") t(suffix, line, agency)",
)
cte("lined", "select p.*, m.line, m.agency from pings p left join label_map m on split_part(p.label, '-', -1) = m.suffix", "pings", "label_map")
cte(
    "seg0",
    """select *, case when lag(ts) over w is null then 0 when ts - lag(ts) over w > 600 or start_time <> lag(start_time) over w
  or start_date <> lag(start_date) over w or direction_id <> lag(direction_id) over w then 1 else 0 end as cut
from lined window w as (partition by vehicle_id order by ts, event_id)""",
    "lined",
)
cte("seg1", "select *, cast(sum(cut) over (partition by vehicle_id order by ts, event_id rows unbounded preceding) as bigint) as trip_no from seg0", "seg0")
cte(
    "points",
    """select * exclude (cut) from (select *, count(*) over (partition by vehicle_id, trip_no) as n_points,
  row_number() over w - 1 as point_no, first_value(route_id) over w as trip_route_id, first_value(direction_id) over w as trip_direction_id,
  first_value(ts) over w as trip_start_ts from seg1 window w as (partition by vehicle_id, trip_no order by ts, event_id)) where n_points >= 5""",
    "seg1",
)
cte("shapes", f"select * from (values {_shape_rows()}) t(line, color, branch_pos, shape_id, short_name, name, direction)")
cte("vertices", f"select * from (values {_vertex_rows()}) t(shape_id, i, lat, lon)")
cte("stops", f"select * from (values {_stop_rows()}) t(shape_id, i, stop_id, stop_name, lat, lng)")
cte(
    "segs",
    """select *, sqrt(len2) as len_m, coalesce(sum(sqrt(len2)) over (partition by shape_id order by seg_no rows between unbounded preceding and 1 preceding), 0.0) as cum_m
from (select *, ab_x*ab_x + ab_y*ab_y as len2 from (select shape_id, seg_no, lat0, lon0, (lat1-lat0)*111320.0::double as ab_y,
  (lon1-lon0)*(111320.0::double*cos(radians((lat0+lat1)/2))) as ab_x, 111320.0::double*cos(radians((lat0+lat1)/2)) as m_lon
  from (select shape_id, i as seg_no, lat as lat0, lon as lon0, lead(lat) over w as lat1, lead(lon) over w as lon1
    from vertices window w as (partition by shape_id order by i)) where lat1 is not null))""",
    "vertices",
)
cte(
    "lengths",
    f"""select shape_id, sum({hav('lat0','lon0','lat1','lon1')}) as length_m from (select shape_id, lat as lat0, lon as lon0,
  lead(lat) over w as lat1, lead(lon) over w as lon1 from vertices window w as (partition by shape_id order by i)) where lat1 is not null group by shape_id""",
    "vertices",
)
cte("planar", "select shape_id, sum(len_m) as planar_m from segs group by shape_id", "segs")
cte(
    "branch_map",
    "select * from (values "
    + ", ".join(f"('{r}', {r % 2}, '{stem}{r % 2}')" for r, stem in testbed.ROUTE_SHAPES.items())
    + ") t(route_id, direction_id, shape_id)",
)
cte("families", "select * from (values ('39', '39A', '39D')) t(line, parent, child)")
cte(
    "assigned",
    """select p.*, coalesce(b.shape_id, f.shape_id) as shape_id, b.shape_id is not null as mapped from points p
  left join branch_map b on b.route_id = p.trip_route_id and b.direction_id = p.trip_direction_id
  left join (select line, direction, max_by(shape_id, branch_pos) as shape_id from shapes group by all) f on f.line = p.line and f.direction = p.trip_direction_id
where p.line in (select line from shapes) and coalesce(b.shape_id, f.shape_id) is not null""",
    "points",
    "branch_map",
    "shapes",
)


def nearest(src: str, cond: str, extra: str = "") -> str:
    """Closest position of every row of ``src`` (aliased p) on each shape matching ``cond``.

    ``src`` needs a unique row key event_id; output one row per (event_id, shape).
    """
    return f"""select * exclude (rn) from (select *, row_number() over (partition by event_id, on_shape order by err2, seg_no) as rn from (
  select *, cum_m + t*len_m as along_m, sqrt(pow(ax - t*ab_x, 2) + pow(ay - t*ab_y, 2)) as offset_m, pow(ax - t*ab_x, 2) + pow(ay - t*ab_y, 2) as err2 from (
    select *, least(greatest(case when len2 > 1e-9 then (ax*ab_x + ay*ab_y)/len2 else 0.0 end, 0.0), 1.0) as t from (
      select p.*, {extra} s.shape_id as on_shape, s.seg_no, s.ab_x, s.ab_y, s.len2, s.len_m, s.cum_m,
        (p.lat - s.lat0)*111320.0::double as ay, (p.lon - s.lon0)*s.m_lon as ax
      from {src} p join segs s on {cond})))) where rn = 1"""


cte("proj_all", "select n.* exclude (t, ax, ay, ab_x, ab_y, len2, len_m, cum_m), l.length_m from (" + nearest("assigned", "s.shape_id = p.shape_id") + ") n join lengths l on l.shape_id = n.shape_id", "assigned", "segs", "lengths")
cte("proj", "select * from proj_all where offset_m <= 150", "proj_all")
