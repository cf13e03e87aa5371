"""Map-relation and schedule imports: relation master, ways, stops and GTFS branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.functions.geo import equirect_m
from fleetlens.operators.scale import small

# fixed values
RELATION_TAGS = [
    "ref", "official_ref", "name", "description", "from", "to", "via", "operator", "network", "colour", "trip_headsign",
    "public_transport:version", "roundtrip", "website",
]
STOP_ROLES = ["stop", "stop_entry_only", "stop_exit_only", "platform", "stop_position", ""]
JOIN_M = 20.0
SAME_STOP_M = 40.0
GTFS_BOX = {"lat": (-35.5, -33.5), "lon": (-59.5, -57.5)}
# grid cells at least as wide as the 40 m limit up to 68° of latitude
CELL_LAT, CELL_LON = 0.0004, 0.001


def osm_relations(elements: DataFrame, allowed_lines: list[int]) -> DataFrame:
    """id, tags → relation_id, line_number and the known non-empty tags; other lines are dropped."""
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    filled = lambda c: F.when(c != "", c)
    number = F.regexp_extract(F.trim(F.coalesce(tag("ref"), F.lit(""))), r"^(\d+)", 1)
    rows = elements.withColumn("line_number", number.try_cast("int"))
    rows = rows.where(F.col("line_number").isin(allowed_lines))
    values = F.filter(
        F.array(
            *[
                F.struct(F.lit(t).alias("key"), (F.coalesce(filled(tag(t)), filled(tag("color"))) if t == "colour" else filled(tag(t))).alias("value"))
                for t in RELATION_TAGS
            ]
        ),
        lambda e: e["value"].isNotNull(),
    )
    out = rows.select(F.col("id").cast("string").alias("relation_id"), "line_number", F.map_from_entries(values).alias("tags"))
    return out.orderBy("line_number", F.coalesce(F.try_element_at("tags", F.lit("ref")), F.lit("")))


def refresh_relations(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh tags win, extra fields of the old row survive, relations no longer listed leave."""
    o = old.select("relation_id", F.col("tags").alias("_old"))
    kept = F.map_filter("_old", lambda k, v: ~F.map_contains_key("tags", k))
    return fresh.join(o, "relation_id", "left").select(
        "relation_id", "line_number", F.when(F.col("_old").isNull(), F.col("tags")).otherwise(F.map_concat(kept, "tags")).alias("tags")
    )


def relations_per_line(relations: DataFrame) -> DataFrame:
    return relations.groupBy("line_number").agg(F.count(F.lit(1)).alias("n"))


def oriented_ways(ways: DataFrame) -> DataFrame:
    """Add ``reversed`` and ``skip`` to (relation_id, pos, points) in member order.

    A way is flipped when its last vertex is nearer to the running end than its
    first. The end depends on how the previous way was laid, so each way maps
    the previous orientation to its own: a constant, the same or the opposite.
    The orientation is the last constant, flipped once per opposite since.
    """
    order = Window.partitionBy("relation_id").orderBy("pos")
    point = lambda c, i: F.element_at(c, i)
    d = lambda a, b: equirect_m(a["lat"], a["lon"], b["lat"], b["lon"])
    w = ways.where(F.size("points") > 0).withColumn("_a", point(F.col("points"), 1)).withColumn("_z", point(F.col("points"), -1))
    w = w.withColumn("_pa", F.lag("_a").over(order)).withColumn("_pz", F.lag("_z").over(order))
    flips = lambda end: F.when(d(end, F.col("_z")) < d(end, F.col("_a")), 1).otherwise(0)
    first = F.col("_pa").isNull()
    # orientation after a previous way laid forward (0) and laid backward (1)
    w = w.withColumn("_f0", F.when(first, 0).otherwise(flips(F.col("_pz")))).withColumn("_f1", F.when(first, 0).otherwise(flips(F.col("_pa"))))
    fixed = F.col("_f0") == F.col("_f1")
    w = w.withColumn("_era", F.sum(F.when(fixed, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    era = Window.partitionBy("relation_id", "_era").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.first("_f0").over(era)
    swaps = F.sum(F.when(fixed, 0).otherwise(F.col("_f0"))).over(era)
    w = w.withColumn("reversed", F.pmod(start + swaps, F.lit(2)) == 1)
    laid = F.when(F.col("reversed"), F.reverse("points")).otherwise(F.col("points"))
    w = w.withColumn("laid", laid).withColumn("_end", F.lag(F.element_at("laid", -1)).over(order))
    near = d(F.col("_end"), F.element_at("laid", 1)) < JOIN_M
    return w.withColumn("skip", F.when(F.col("_end").isNull(), 0).when(near, 1).otherwise(0)).select("relation_id", "pos", "reversed", "skip", "laid")


def stitch_ways(ways: DataFrame) -> DataFrame:
    """One polyline per relation. A relation has at most 32,000 members and a way 2,000 vertices."""
    part = F.slice("laid", F.col("skip") + 1, F.size("laid"))
    parts = oriented_ways(ways).select("relation_id", F.struct("pos", part.alias("p")).alias("x"))
    return parts.groupBy("relation_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(
        "relation_id", F.flatten(F.transform("xs", lambda x: x["p"])).alias("points")
    )


def extract_stops(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stops of a relation in member order: role allow-list, first entry per node, no platform near a stop position.

    Nearness is looked up over a grid: a platform is compared only with the
    stop positions of its own and the eight neighbouring cells.
    """
    known = members.where(F.col("role").isin(STOP_ROLES))
    rest = [c for c in known.columns if c not in ("relation_id", "ref", "pos")]
    firsts = known.groupBy("relation_id", "ref").agg(F.min("pos").alias("pos"), F.min_by(F.struct(*rest), "pos").alias("m"))
    c = firsts.select("relation_id", "ref", "pos", "m.*").where("lat is not null and lon is not null")
    cell = lambda col, width: F.floor(F.col(col) / F.lit(width))
    anchors = c.where("role <> 'platform'").select(
        "relation_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), cell("lat", CELL_LAT).alias("_cy"), cell("lon", CELL_LON).alias("_cx")
    )
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    platforms = (
        c.where("role = 'platform'")
        .withColumn("_o", around)
        .withColumn("_cy", cell("lat", CELL_LAT) + F.col("_o.dy"))
        .withColumn("_cx", cell("lon", CELL_LON) + F.col("_o.dx"))
    )
    doubled = (
        platforms.join(anchors, ["relation_id", "_cy", "_cx"])
        .where(equirect_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) < SAME_STOP_M)
        .select("relation_id", "ref")
        .distinct()
    )
    kept = c.join(doubled, ["relation_id", "ref"], "left_anti").join(nodes.select("ref", "name", F.col("code").alias("_code")), "ref", "left")
    blank = lambda col: F.when(F.col(col) != "", F.col(col))
    return kept.select(
        "relation_id", "pos", F.concat(F.lit("n"), F.col("ref").cast("string")).alias("id"), "lat", F.col("lon").alias("lng"),
        blank("name").alias("name"), blank("_code").alias("ref"),
    )


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        name: spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(ddl).csv(f"{folder}/{name}.txt")
        for name, ddl in schemas.GTFS.items()
    }


def gtfs_branches(
    routes: DataFrame, trips: DataFrame, shapes: DataFrame, stop_times: DataFrame, stops: DataFrame, refs: DataFrame, lines: list[str], order: str = "pos"
) -> DataFrame:
    """Branches of the target lines: the first trip per (line, headsign, direction) gives shape and stops.

    ``routes`` and ``trips`` carry ``order``, their file position. ``refs`` maps
    shape_id to a known short name.
    """
    target = routes.where(F.col("route_short_name").isin(lines)).select(
        "route_id", F.col("route_short_name").alias("line"), F.col("route_color").alias("color"), F.col(order).alias("_rpos")
    )
    colors = target.groupBy("line").agg(F.min_by(F.coalesce("color", F.lit("")), "_rpos").alias("color"))
    line_of = target.groupBy("route_id").agg(F.max_by("line", "_rpos").alias("line"))
    first = (
        trips.join(small(line_of), "route_id")
        .groupBy("line", F.col("trip_headsign").alias("name"), F.col("direction_id").alias("direction"))
        .agg(F.min_by(F.struct("shape_id", "trip_id"), order).alias("t"))
        .select("line", "name", "direction", "t.*")
    )
    rank = F.dense_rank().over(Window.partitionBy("line").orderBy("name"))
    first = first.withColumn("_hs", rank)
    # path and stop lists are as long as one path; only those of chosen trips are gathered
    wanted = small(first.select("shape_id").distinct())
    path = (
        shapes.join(wanted, "shape_id", "left_semi")
        .groupBy("shape_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("shape_pt_sequence").alias("s"), F.col("shape_pt_lat").alias("lat"), F.col("shape_pt_lon").alias("lon")))).alias("p"))
        .select("shape_id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))
    )
    lat, lon = F.get("points", F.lit(0))["lat"], F.get("points", F.lit(0))["lon"]
    inside = (lat > GTFS_BOX["lat"][0]) & (lat < GTFS_BOX["lat"][1]) & (lon > GTFS_BOX["lon"][0]) & (lon < GTFS_BOX["lon"][1])
    halts = (
        stop_times.join(small(first.select("trip_id").distinct()), "trip_id", "left_semi")
        .join(stops, "stop_id")
        .groupBy("trip_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("stop_sequence").alias("s"), F.col("stop_id").alias("id"), F.col("stop_name").alias("name"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lng")))).alias("h"))
        .select("trip_id", F.transform("h", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("stops"))
    )
    letter = F.regexp_extract("name", r"^(\d+[A-Z])\b", 1)
    own = F.when(F.substring(letter, 1, F.length(letter) - 1) == F.col("line"), letter)
    short = F.coalesce(F.col("ref"), own, F.concat("line", F.lit("R"), F.col("_hs").cast("string")))
    pos = Window.partitionBy("line").orderBy("_hs", "direction")
    return (
        first.join(path.where(inside), "shape_id")
        .join(halts, "trip_id", "left")
        .join(small(refs.select("shape_id", F.when(F.col("ref") != "", F.col("ref")).alias("ref"))), "shape_id", "left")
        .join(small(colors), "line")
        .select(
            "line",
            "color",
            (F.row_number().over(pos) - 1).alias("branch_pos"),
            "shape_id",
            short.alias("short_name"),
            "name",
            "direction",
            "points",
            F.coalesce("stops", F.array().cast(halts.schema["stops"].dataType)).alias("stops"),
        )
    )
