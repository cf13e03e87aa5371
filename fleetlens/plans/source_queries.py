"""Sources and sinks: shapes and maps, schedule and relation imports, training layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators import eta_models as em
from fleetlens.operators import features as fx
from fleetlens.operators.temporal import temporal_split
from fleetlens.operators.trips import trip_summary
from fleetlens.operators.scale import small
from fleetlens.plans import testbed as tb
from fleetlens.plans.feature_queries import eta
from fleetlens.plans.geometry_queries import own_shapes
from fleetlens.plans.oracle import cte, sql
from fleetlens.plans.registry import query, r, rq
from fleetlens.session import shared_dir
from fleetlens.sources import relations as rel
from fleetlens.sources import shapes as ss
from fleetlens.sources import sinks

# ---- shapes and maps -------------------------------------------------------------------------


def written(spark, docs, purpose):
    """Folder of the documents' files."""
    path = shared_dir(spark, purpose)
    ss.write_documents(docs, path)
    return path


@query(
    "read_shapes",
    sql(
        f"""select v.line, v.shape_id, cast(max(v.h) as integer) - cast((select min(h) from own_vertices) as integer) as hour, max(v.n) as n_points, {rq('sum(lat*(i+1))', 'lat_check', 7)}, {rq('sum(lon*(i+1))', 'lon_check', 7)},
        cast(sum(case when i % 3 = 0 then 1 else 0 end) as bigint) as n_stops from own_vertices v where v.line in ('39', '26') group by v.line, v.shape_id""",
        "own_vertices",
    ),
)
def read_shapes(spark, sf):
    """Shape documents written as JSON files and read back."""
    own = own_shapes(spark, sf)
    first = own.agg(F.min("branch_pos").alias("_h0")).withColumn("_k", F.lit(0))
    # the list position replaces branch_pos on reading; the hour is kept in the colour-free name
    docs = ss.shapes_document(own.withColumn("name", F.col("branch_pos").cast("string")))
    back = ss.read_shapes(spark, written(spark, docs, "shapes"), ["39", "26"])
    check = lambda f: F.aggregate(F.transform("points", lambda p, i: p[f] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return back.withColumn("_k", F.lit(0)).join(small(first), "_k").select(
        "line", "shape_id", (F.col("name").cast("int") - F.col("_h0")).alias("hour"), F.size("points").cast("long").alias("n_points"),
        r(check("lat"), 7).alias("lat_check"), r(check("lon"), 7).alias("lon_check"), F.size("stops").cast("long").alias("n_stops"),
    )


cte(
    "label_doc",
    """select cast(c_custkey as varchar) as suffix, case when c_custkey % 6 = 0 then null when c_custkey % 6 = 1 then '' else cast(c_custkey % 250 as varchar) end as line, 'A' || c_nationkey as agency from customer""",
)


def label_docs(spark, sf):
    """One label-map document per nation."""
    k = F.col("c_custkey")
    line = F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 == 1, "").otherwise((k % 250).cast("string"))
    entry = F.struct(k.cast("string").alias("key"), F.struct(line.alias("line"), F.concat(F.lit("A"), "c_nationkey").alias("agencyName")).alias("value"))
    # a document per 64 customers keeps every document small
    return (
        tb.table(spark, sf, "customer")
        .groupBy(F.floor(k / 64).alias("doc"))
        .agg(F.map_from_entries(F.collect_list(entry)).alias("map"))
        .select(F.to_json(F.struct("map")).alias("text"))
    )


@query("read_label_map", sql("select suffix, line, agency from label_doc where coalesce(line, '') <> ''", "label_doc"))
def read_label_map(spark, sf):
    return ss.read_label_map(spark, written(spark, label_docs(spark, sf), "labels"))


@query(
    "label_map_from_shapes",
    sql(
        """select p.event_id, coalesce(m.line, 'none') as line from pings p left join (select short_name as suffix, max(line) as line from shapes group by 1 union select line, line from shapes) m
        on m.suffix = case p.event_id % 4 when 0 then '39A' when 1 then '151' when 2 then '42A' else 'zz' end""",
        "pings",
        "shapes",
    ),
)
def label_map_from_shapes(spark, sf):
    e = F.col("event_id")
    suffix = F.when(e % 4 == 0, "39A").when(e % 4 == 1, "151").when(e % 4 == 2, "42A").otherwise("zz")
    m = ss.label_map_from_shapes(tb.shapes(spark))
    return tb.pings(spark, sf).select("event_id", suffix.alias("suffix")).join(small(m), "suffix", "left").select("event_id", F.coalesce("line", F.lit("none")).alias("line"))


def branch_docs(spark, sf):
    k = F.col("p_partkey")
    entry = F.struct(
        F.when(k % 9 != 0, k.cast("string")).alias("route_id"),
        F.when(k % 7 != 0, (k % 2).cast("int")).alias("direction_id"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "").otherwise(F.concat(F.lit("s"), k % 13)).alias("shape_id"),
        F.lit("active").alias("status"),
    )
    per_line = tb.table(spark, sf, "part").groupBy(F.col("p_size").cast("string").alias("line"), F.floor(k / 3200).alias("doc")).agg(F.collect_list(entry).alias("entries"))
    return per_line.select(F.to_json(F.struct(F.map_from_arrays(F.array("line"), F.array(F.struct("entries"))).alias("lines"))).alias("text"))


@query(
    "read_branch_map",
    sql(
        "select cast(p_size as varchar) as line, cast(p_partkey as varchar) as route_id, cast(p_partkey % 2 as integer) as direction_id, 's' || (p_partkey % 13) as shape_id from part where p_partkey % 9 <> 0 and p_partkey % 7 <> 0 and p_partkey % 5 > 1"
    ),
)
def read_branch_map(spark, sf):
    return ss.read_branch_map(spark, written(spark, branch_docs(spark, sf), "branches")).select("line", "route_id", "direction_id", "shape_id")


@query(
    "read_families",
    sql("select cast(s_nationkey as varchar) as line, 'P' || (s_suppkey % 3) as parent, 'C' || s_suppkey as child from supplier"),
)
def read_families(spark, sf):
    s = tb.table(spark, sf, "supplier")
    kids = s.groupBy(F.col("s_nationkey").cast("string").alias("line"), F.concat(F.lit("P"), F.col("s_suppkey") % 3).alias("parent"), F.floor(F.col("s_suppkey") / 4800).alias("d")).agg(
        F.collect_list(F.concat(F.lit("C"), "s_suppkey")).alias("kids")
    )
    docs = kids.select(F.to_json(F.struct("line", F.lit("test").alias("description"), F.map_from_arrays(F.array("parent"), F.array("kids")).alias("families"))).alias("text"))
    return ss.read_families(spark, written(spark, docs, "families"))


# ---- schedule import: routes from part, trips from orders, paths and stops from lineitem -----------

GTFS_LINES = ["39", "42", "151"]
cte("g_routes", "select 'r' || p_partkey as route_id, case p_partkey % 6 when 0 then '39' when 1 then '42' when 2 then '151' when 3 then '7' when 4 then '39' else '92' end as line, case when p_partkey % 4 = 0 then '' else 'C' || p_size end as color, p_partkey as pos from part")
cte(
    "g_trips",
    """select 'r' || o_custkey as route_id, 't' || o_orderkey as trip_id, case o_orderkey % 5 when 0 then '39A Barracas' when 1 then 'Centro' when 2 then '42B Oeste' when 3 then '151Z' else '39AB mix' end || ' ' || (o_orderkey // 5 % 40) as headsign,
  cast(o_orderkey % 2 as integer) as direction, 's' || o_orderkey as shape_id, o_orderkey as pos from orders""",
)
cte("g_shapes", "select 's' || l_orderkey as shape_id, case when l_orderkey % 10 = 0 then -20.0::double else -34.6::double + l_partkey % 100*0.001::double end as lat, -58.4::double + l_suppkey % 100*0.001::double as lon, l_linenumber as seq from lineitem")
cte(
    "g_first",
    """select f.*, dense_rank() over (partition by line order by headsign) as hs from (select r.line, t.headsign, t.direction, arg_min(t.shape_id, t.pos) as shape_id, arg_min(t.trip_id, t.pos) as trip_id
  from g_trips t join g_routes r on r.route_id = t.route_id where r.line in ('39', '42', '151') group by all) f""",
    "g_trips",
    "g_routes",
)
cte(
    "g_paths",
    "select shape_id, count(*) as n_points, sum(lat) as lat_check, arg_min(lat, (seq, lat, lon)) as lat0, arg_min(lon, (seq, lat, lon)) as lon0 from g_shapes group by shape_id",
    "g_shapes",
)
cte("g_halts", "select 't' || l_orderkey as trip_id, count(*) as n_stops, string_agg('p' || l_partkey, ',' order by l_linenumber, 'p' || l_partkey) as stop_ids from lineitem where l_partkey % 3 <> 0 group by l_orderkey")


@query(
    "gtfs_branches",
    sql(
        f"""select f.line, c.color, f.headsign as name, f.direction, f.shape_id, case when cast(substr(f.shape_id, 2) as bigint) % 11 = 0 then 'X' || f.shape_id when regexp_matches(f.headsign, '^' || f.line || '[A-Z]\\b') then substr(f.headsign, 1, length(f.line) + 1) else f.line || 'R' || hs end as short_name,
        p.n_points, {rq('p.lat_check', 'lat_check', 5)}, coalesce(h.n_stops, 0) as n_stops, coalesce(h.stop_ids, '') as stop_ids from g_first f join g_paths p on p.shape_id = f.shape_id and lat0 > -35.5 and lat0 < -33.5 and lon0 > -59.5 and lon0 < -57.5
        left join g_halts h on h.trip_id = f.trip_id join (select line, arg_min(color, pos) as color from g_routes group by line) c on c.line = f.line""",
        "g_first",
        "g_paths",
        "g_halts",
        "g_routes",
    ),
)
def gtfs_branches(spark, sf):
    part, orders, items = (tb.table(spark, sf, t) for t in ("part", "orders", "lineitem"))
    pk, ok = F.col("p_partkey"), F.col("o_orderkey")
    name = lambda prefix, c: F.concat(F.lit(prefix), c)
    routes = part.select(
        name("r", pk).alias("route_id"),
        F.when(pk % 6 == 0, "39").when(pk % 6 == 1, "42").when(pk % 6 == 2, "151").when(pk % 6 == 3, "7").when(pk % 6 == 4, "39").otherwise("92").alias("route_short_name"),
        F.when(pk % 4 == 0, "").otherwise(name("C", F.col("p_size"))).alias("route_color"),
        pk.alias("pos"),
    )
    head = F.when(ok % 5 == 0, "39A Barracas").when(ok % 5 == 1, "Centro").when(ok % 5 == 2, "42B Oeste").when(ok % 5 == 3, "151Z").otherwise("39AB mix")
    trips = orders.select(
        name("r", F.col("o_custkey")).alias("route_id"), name("t", ok).alias("trip_id"),
        F.concat(head, F.lit(" "), (F.floor(ok / 5) % 40).cast("string")).alias("trip_headsign"),
        (ok % 2).cast("int").alias("direction_id"), name("s", ok).alias("shape_id"), ok.alias("pos"),
    )
    lk = F.col("l_orderkey")
    shapes = items.select(
        name("s", lk).alias("shape_id"),
        F.when(lk % 10 == 0, -20.0).otherwise(F.lit(-34.6) + (F.col("l_partkey") % 100) * F.lit(0.001)).alias("shape_pt_lat"),
        (F.lit(-58.4) + (F.col("l_suppkey") % 100) * F.lit(0.001)).alias("shape_pt_lon"),
        F.col("l_linenumber").alias("shape_pt_sequence"),
    )
    times = items.select(name("t", lk).alias("trip_id"), name("p", F.col("l_partkey")).alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"))
    # a third of the stops bear ids that no trip calls at, so that the trips' own are unknown
    stops = part.select(F.when(pk % 3 != 0, name("p", pk)).otherwise(name("q", pk)).alias("stop_id"), F.col("p_name").alias("stop_name"), F.lit(-34.6).alias("stop_lat"), F.lit(-58.4).alias("stop_lon"))
    refs = orders.where(ok % 11 == 0).select(name("s", ok).alias("shape_id"), F.concat(F.lit("Xs"), ok).alias("ref"))
    path = shared_dir(spark, "schedule")
    for table, rows in {"routes": routes, "trips": trips, "shapes": shapes, "stop_times": times, "stops": stops}.items():
        # the columns of the format, in its order
        cols = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in spark.createDataFrame([], schemas.GTFS[table]).columns]
        rows.select(*cols).write.option("header", True).csv(f"{path}/{table}.txt")
    feed = rel.read_gtfs(spark, path)
    # a feed of several files has no line order; the number in an id stands for it
    placed = lambda t, c: feed[t].withColumn("pos", F.substring(c, 2, 20).cast("long"))
    b = rel.gtfs_branches(placed("routes", "route_id"), placed("trips", "trip_id"), feed["shapes"], feed["stop_times"], feed["stops"], refs, GTFS_LINES)
    check = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lat"])
    return b.select(
        "line", "color", "name", "direction", "shape_id", "short_name", F.size("points").cast("long").alias("n_points"), r(check, 5).alias("lat_check"),
        F.size("stops").cast("long").alias("n_stops"), F.concat_ws(",", F.transform("stops", lambda s: s["id"])).alias("stop_ids"),
    )


# ---- relations ---------------------------------------------------------------------------------

ALLOWED = [1, 2, 4, 7, 39, 42]
ALLOWED_SQL = ", ".join(map(str, ALLOWED))
cte(
    "relations",
    f"""select cast(p_partkey as varchar) as relation_id, cast(regexp_extract(trim(ref), '^(\\d+)', 1) as integer) as line_number, ref, nm, colour from (
  select p_partkey, case p_partkey % 8 when 0 then '39A' when 1 then ' 42 B' when 2 then '7' when 3 then '' when 4 then 'N39' when 5 then '999' when 6 then '4C' else '2' end as ref, p_name as nm,
  case when p_partkey % 3 = 0 then '#AABBCC' when p_partkey % 3 = 1 then 'red' end as colour from part) where regexp_extract(trim(ref), '^(\\d+)', 1) <> '' and cast(regexp_extract(trim(ref), '^(\\d+)', 1) as integer) in ({ALLOWED_SQL})""",
)


def elements(spark, sf):
    k = F.col("p_partkey")
    ref = F.when(k % 8 == 0, "39A").when(k % 8 == 1, " 42 B").when(k % 8 == 2, "7").when(k % 8 == 3, "").when(k % 8 == 4, "N39").when(k % 8 == 5, "999").when(k % 8 == 6, "4C").otherwise("2")
    return tb.table(spark, sf, "part").select(
        k.alias("id"),
        F.map_from_arrays(
            F.array(*[F.lit(x) for x in ("ref", "name", "colour", "color", "ignored")]),
            F.array(ref, F.col("p_name"), F.when(k % 3 == 0, "#AABBCC"), F.when(k % 3 == 1, "red"), F.lit("x")),
        ).alias("tags"),
    )


def tag(name):
    return F.try_element_at("tags", F.lit(name))


@query("osm_relations", sql("select relation_id, line_number, ref, nm as name, colour, cast(2 + case when colour is not null then 1 else 0 end as integer) as n_tags from relations", "relations"))
def osm_relations(spark, sf):
    rows = rel.osm_relations(elements(spark, sf), ALLOWED)
    return rows.select("relation_id", "line_number", tag("ref").alias("ref"), tag("name").alias("name"), tag("colour").alias("colour"), F.size("tags").alias("n_tags"))


@query(
    "refresh_relations",
    sql(
        """select relation_id, line_number, ref, coalesce(colour, case when cast(relation_id as bigint) % 2 = 0 then 'old' end) as colour, case when cast(relation_id as bigint) % 2 = 0 then 'note ' || relation_id end as note from relations""",
        "relations",
    ),
)
def refresh_relations(spark, sf):
    fresh = rel.osm_relations(elements(spark, sf), ALLOWED)
    pairs = F.map_from_arrays(F.array(F.lit("colour"), F.lit("note"), F.lit("ref")), F.array(F.lit("old"), F.concat(F.lit("note "), "relation_id"), F.lit("stale")))
    old = tb.table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("relation_id")).withColumn("tags", pairs)
    out = rel.refresh_relations(old, fresh)
    return out.select("relation_id", "line_number", tag("ref").alias("ref"), tag("colour").alias("colour"), tag("note").alias("note"))


@query("relations_per_line", sql("select line_number, count(*) as n from relations group by all", "relations"))
def relations_per_line(spark, sf):
    return rel.relations_per_line(rel.osm_relations(elements(spark, sf), ALLOWED))


# ways: one per line item, three vertices along the order, some laid backwards or with a gap
cte(
    "ways",
    """select *, lat0 + 0.00005::double*(m % 3) as alat, lon0 + 0.0009::double as zlon, lat0 as zlat from (select l_orderkey as relation_id, (l_linenumber*100000::bigint + l_partkey)*100000 + l_suppkey as pos, l_partkey as m, l_suppkey % 2 = 1 as back,
  -34.6::double + 0.0001::double*(l_orderkey % 7) as lat0, -58.4::double + 0.001::double*l_linenumber + case when l_partkey % 5 = 0 then 0.0005::double else 0.0 end as lon0 from lineitem)""",
)
cte(
    "way_ends",
    """select relation_id, row_number() over (partition by relation_id order by pos) as k, pos, case when back then zlat else alat end as fy, case when back then zlon else lon0 end as fx, case when back then alat else zlat end as ly, case when back then lon0 else zlon end as lx from ways""",
    "ways",
)
DIST = "sqrt(pow({a}y-{b}y,2) + pow(({a}x-{b}x)*cos(radians(({a}y+{b}y)/2)),2))*111320.0"
cte(
    "rec_stitch",
    f"""select relation_id, k, false as flipped, 0 as skip, ly as ey, lx as ex from way_ends where k = 1 union all
  select relation_id, k, flipped, case when {DIST.format(a='o', b='s')} < 20 then 1 else 0 end, case when flipped then fy else ly end, case when flipped then fx else lx end from (
    select *, case when flipped then ly else fy end as sy, case when flipped then lx else fx end as sx from (
      select w.relation_id, w.k, w.fy, w.fx, w.ly, w.lx, s.ey as oy, s.ex as ox, {DIST.format(a='s.e', b='w.l')} < {DIST.format(a='s.e', b='w.f')} as flipped from rec_stitch s join way_ends w on w.relation_id = s.relation_id and w.k = s.k + 1))""",
    "way_ends",
)


def ways(spark, sf):
    lat0 = F.lit(-34.6) + F.lit(0.0001) * (F.col("l_orderkey") % 7).cast("double")
    lon0 = F.lit(-58.4) + F.lit(0.001) * F.col("l_linenumber").cast("double") + F.when(F.col("l_partkey") % 5 == 0, 0.0005).otherwise(0.0)
    at = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    pts = F.array(at(lat0 + F.lit(0.00005) * (F.col("l_partkey") % 3).cast("double"), lon0), at(lat0, lon0 + 0.0004), at(lat0, lon0 + 0.0009))
    return tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("relation_id"), ((F.col("l_linenumber") * F.lit(100000).cast("long") + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("pos"), F.when(F.col("l_suppkey") % 2 == 1, F.reverse(pts)).otherwise(pts).alias("points")
    )


@query(
    "stitch_ways",
    sql(
        f"select relation_id, cast(count(*)*3 - sum(skip) as bigint) as n_points, cast(sum(case when flipped then k else 0 end) as bigint) as flip_check, {rq('arg_max(ey, k)', 'end_lat', 6)}, {rq('arg_max(ex, k)', 'end_lon', 6)} from rec_stitch group by relation_id",
        "rec_stitch",
    ),
)
def stitch_ways(spark, sf):
    laid = rel.oriented_ways(ways(spark, sf))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("relation_id").orderBy("pos"))
    flips = laid.withColumn("k", k).groupBy("relation_id").agg(F.sum(F.when(F.col("reversed"), F.col("k")).otherwise(0)).alias("flip_check"))
    path = rel.stitch_ways(ways(spark, sf))
    end = F.element_at("points", -1)
    return path.join(flips, "relation_id").select(
        "relation_id", F.size("points").cast("long").alias("n_points"), "flip_check", r(end["lat"]).alias("end_lat"), r(end["lon"]).alias("end_lon")
    )


ROLES = ["stop", "platform", "", "forward", "stop_exit_only"]
cte(
    "members",
    """select o_custkey as relation_id, ((l_orderkey*10 + l_linenumber)*100000 + l_partkey)*100000 + l_suppkey as pos, l_partkey % 200 as ref, case l_suppkey % 5 when 0 then 'stop' when 1 then 'platform' when 2 then '' when 3 then 'forward' else 'stop_exit_only' end as role,
  case when l_partkey % 200 = 7 then null else -34.6::double + 0.00021::double*(l_partkey % 200 % 14) end as lat, -58.4::double + 0.00027::double*(l_partkey % 200 // 14) as lon from lineitem join orders on o_orderkey = l_orderkey""",
)
cte(
    "stop_cands",
    """select * from (select *, row_number() over (partition by relation_id, ref order by pos) as rn from members where role in ('stop', 'platform', '', 'stop_exit_only')) where rn = 1 and lat is not null""",
    "members",
)


@query(
    "extract_stops",
    sql(
        """select c.relation_id, c.pos, 'n' || c.ref as id, case when c.ref % 4 <> 0 then 'Stop ' || c.ref end as name from stop_cands c where not (c.role = 'platform' and exists (
        select 1 from stop_cands s where s.relation_id = c.relation_id and s.role <> 'platform' and sqrt(pow(c.lat-s.lat,2) + pow((c.lon-s.lon)*cos(radians((c.lat+s.lat)/2)),2))*111320.0 < 40))""",
        "stop_cands",
    ),
)
def extract_stops(spark, sf):
    items = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    n = F.col("l_partkey") % 200
    s = F.col("l_suppkey") % 5
    members = items.join(orders, "l_orderkey").select(
        F.col("o_custkey").alias("relation_id"),
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("pos"),
        n.alias("ref"),
        F.when(s == 0, "stop").when(s == 1, "platform").when(s == 2, "").when(s == 3, "forward").otherwise("stop_exit_only").alias("role"),
        F.when(n != 7, F.lit(-34.6) + F.lit(0.00021) * (n % 14).cast("double")).alias("lat"),
        (F.lit(-58.4) + F.lit(0.00027) * F.floor(n / 14).cast("double")).alias("lon"),
    )
    nodes = spark.range(200).select(F.col("id").alias("ref"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("Stop "), F.col("id").cast("string"))).otherwise("").alias("name"), F.lit("").alias("code"))
    return rel.extract_stops(members, nodes).select("relation_id", "pos", "id", "name")


# ---- sinks and layout ------------------------------------------------------------------------


@query(
    "write_training",
    sql(
        """select line, day, count(*) as n, cast(sum(observed_eta_s) as double) as eta_sum, cast(sum(seg_idx) as bigint) as seg_sum, cast(sum(case when last_bus_found then 1 else 0 end) as bigint) as n_found from eta group by line, day""",
        "eta",
    ),
)
def write_training(spark, sf):
    """Written twice: the second run replaces the partitions it brings and leaves the others."""
    path = shared_dir(spark, "training")
    rows = eta(spark, sf)
    sinks.write_training(rows, path)
    sinks.write_training(rows.where("line in ('39', '26')"), path)
    back = sinks.read_training(spark, path)
    return back.groupBy(F.col("line").cast("string").alias("line"), F.date_format(F.to_date("day"), "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("observed_eta_s").cast("double")).alias("eta_sum"), F.sum("seg_idx").alias("seg_sum"),
        F.sum(F.when(F.col("last_bus_found"), 1).otherwise(0)).alias("n_found"),
    )


cte("wanted", "select line, day from (select distinct line from shapes), (select distinct day from pings)", "shapes", "pings")
cte("manifest", "select w.line, w.day, count(e.ramal_id) as n_rows from wanted w left join eta e on e.line = w.line and e.day = w.day where w.day < '2024-01-20' group by w.line, w.day", "wanted", "eta")


@query(
    "build_pending",
    sql("select w.line, w.day, count(e.ramal_id) as n_rows, 1 as n_entries, count(e.ramal_id) as n_stored from wanted w left join eta e on e.line = w.line and e.day = w.day group by w.line, w.day", "wanted", "eta"),
)
def build_pending(spark, sf):
    """Four runs: the early days, the same again, the late ones broken off ahead of their commit, and all of them."""
    path, log = shared_dir(spark, "training"), shared_dir(spark, "log")
    rows, pairs = eta(spark, sf), tb.stored(wanted(spark, sf), "wanted")
    make = lambda todo: rows.join(todo, ["line", "day"], "left_semi")
    early = pairs.where("day < '2024-01-20'")
    sinks.build_pending(early, make, path, log)
    if not sinks.build_pending(early, make, path, log).isEmpty():
        raise ValueError("a run without anything pending has built something")
    sinks.write_training(make(pairs.where("day >= '2024-01-20'")), path)
    sinks.build_pending(pairs, make, path, log)
    back = sinks.read_training(spark, path).groupBy(F.col("line").cast("string").alias("line"), F.date_format(F.to_date("day"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_stored"))
    entries = sinks.read_log(spark, log).groupBy("line", "day").agg(F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).cast("int").alias("n_entries"))
    return entries.join(back, ["line", "day"], "left").fillna(0, ["n_stored"])


def wanted(spark, sf):
    # every line of the shapes on every recorded day; both lists are calendar- and line-sized
    days = tb.pings(spark, sf).select("day").distinct()
    lines = F.array_sort(F.array(*[F.lit(x) for x in tb.LINES]))
    return days.select(F.explode(lines).alias("line"), "day")


def manifest(spark, sf):
    return sinks.record_done(wanted(spark, sf).where("day < '2024-01-20'"), eta(spark, sf))


@query("record_done", sql("select line, day, n_rows from manifest", "manifest"))
def record_done(spark, sf):
    return manifest(spark, sf)


@query("pending_partitions", sql("select line, day from wanted where day >= '2024-01-20'", "wanted"))
def pending_partitions(spark, sf):
    return sinks.pending_partitions(wanted(spark, sf), manifest(spark, sf))


@query("list_done_days", sql("select distinct day from manifest where line in ('39', '42')", "manifest"))
def list_done_days(spark, sf):
    return sinks.list_done_days(manifest(spark, sf), ["39", "42"])


@query("temporal_split", sql("select vehicle_id, trip_no, p_pos, f_pos, is_train from split", "split"))
def split_rows(spark, sf):
    train, val = temporal_split(eta(spark, sf))
    keys = ["vehicle_id", "trip_no", "p_pos", "f_pos"]
    return train.select(*keys, F.lit(True).alias("is_train")).unionByName(val.select(*keys, F.lit(False).alias("is_train")))


@query(
    "trips_summary",
    sql("select vehicle_id, trip_no, trip_route_id, trip_direction_id, trip_start_ts, line, count(*) as n_points from proj group by all", "proj"),
)
def trips_summary(spark, sf):
    p = tb.projected_table(spark, sf)
    return sinks.trips_summary([trip_summary(p)])


@query("save_load_lookup", sql(f"select level, ramal_id, seg_idx, hour, dow, {rq('avg_speed')} from lookup", "lookup"))
def save_load_lookup(spark, sf):
    path = shared_dir(spark, "lookup")
    em.save_lookup(em.fit_speed_lookup(eta(spark, sf)), path)
    return em.load_lookup(spark, path).select("level", "ramal_id", "seg_idx", "hour", "dow", r("avg_speed").alias("avg_speed"))


@query("nested_json", sql(f"select ramal_id, cast(bucket as varchar) as bucket, {rq('expected_time_s', None, 4)} from medians", "medians"))
def nested_json(spark, sf):
    """Medians exported as {branch: {bucket: seconds}} and parsed back."""
    path = shared_dir(spark, "medians")
    sinks.write_json_lines(sinks.to_nested_json(fx.schedule_medians(eta(spark, sf)), "ramal_id", "bucket", "expected_time_s"), path)
    back = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, map<string, double>>")).alias("ramal_id", "m"))
    return back.select("ramal_id", F.explode("m").alias("bucket", "v")).select("ramal_id", "bucket", r("v", 4).alias("expected_time_s"))
