"""Route geometry: lengths, segment tables, projections and branch choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import geo
from fleetlens.operators.scale import exact_quantiles, small


def path_length(points) -> "F.Column":
    """Haversine length of an array of (lat, lon)."""
    pairs = F.arrays_zip(
        F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"),
        F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))).alias("b"),
    )
    step = lambda acc, p: acc + geo.haversine_m(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"])
    return F.aggregate(pairs, F.lit(0.0), step)


def shape_lengths(shapes: DataFrame) -> DataFrame:
    """length_key, length_m under the shape id and under "line-direction" (later branch wins)."""
    usable = shapes.where(F.size("points") >= 2).withColumn("length_m", path_length(F.col("points")))
    by_id = usable.select(F.col("shape_id").alias("length_key"), "length_m", "line", "branch_pos")
    by_line = usable.select(
        F.concat_ws("-", "line", F.coalesce("direction", F.lit(0)).cast("string")).alias("length_key"),
        "length_m",
        "line",
        "branch_pos",
    )
    return (
        by_id.unionByName(by_line)
        .groupBy("length_key")
        .agg(F.max_by("length_m", F.struct("line", "branch_pos")).alias("length_m"))
    )


def shape_segments(shapes: DataFrame) -> DataFrame:
    """One row per path segment with its planar vector, length and start distance."""
    vertices = shapes.select("shape_id", F.posexplode("points").alias("seg_no", "p"))
    along = Window.partitionBy("shape_id").orderBy("seg_no")
    legs = (
        vertices.withColumn("q", F.lead("p").over(along))
        .where("q is not null")
        .select(
            "shape_id",
            "seg_no",
            F.col("p.lat").alias("lat0"),
            F.col("p.lon").alias("lon0"),
            (F.lit(geo.METRES_PER_DEGREE) * F.cos(F.radians((F.col("p.lat") + F.col("q.lat")) / 2.0))).alias("m_lon"),
            (F.col("q.lat") - F.col("p.lat")).alias("dlat"),
            (F.col("q.lon") - F.col("p.lon")).alias("dlon"),
        )
        .withColumn("ab_y", F.col("dlat") * geo.METRES_PER_DEGREE)
        .withColumn("ab_x", F.col("dlon") * F.col("m_lon"))
        .withColumn("len2", F.col("ab_x") * F.col("ab_x") + F.col("ab_y") * F.col("ab_y"))
        .withColumn("safe_len2", F.when(F.col("len2") > geo.MIN_SEGMENT_SQUARED_M, F.col("len2")).otherwise(1.0))
        .withColumn("len_m", F.sqrt("len2"))
    )
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return legs.withColumn("cum_m", F.coalesce(F.sum("len_m").over(before), F.lit(0.0)))


SEGMENT_FIELDS = ["seg_no", "lat0", "lon0", "m_lon", "ab_x", "ab_y", "len2", "safe_len2", "len_m", "cum_m"]


def prepared_paths(shapes: DataFrame) -> DataFrame:
    """One row per shape with its ordered segment array; the form projections join to.

    Built from the branch row itself, so it costs no shuffle. A shape of one
    vertex yields a zero-length segment.
    """
    pts = F.col("points")
    n = F.size(pts)
    one = F.transform(
        pts,
        lambda p: F.struct(p["lat"].alias("alat"), p["lon"].alias("alon"), p["lat"].alias("blat"), p["lon"].alias("blon")),
    )
    many = F.zip_with(
        F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(pts, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a["lat"].alias("alat"), a["lon"].alias("alon"), b["lat"].alias("blat"), b["lon"].alias("blon")),
    )
    flat = F.transform(
        F.when(n > 1, many).otherwise(one),
        lambda s: F.struct(
            s["alat"].alias("lat0"),
            s["alon"].alias("lon0"),
            (F.lit(geo.METRES_PER_DEGREE) * F.cos(F.radians((s["alat"] + s["blat"]) / 2.0))).alias("m_lon"),
            ((s["blat"] - s["alat"]) * geo.METRES_PER_DEGREE).alias("ab_y"),
            (s["blon"] - s["alon"]).alias("dlon"),
        ),
    )
    vector = F.transform(
        flat,
        lambda s: F.struct(s["lat0"], s["lon0"], s["m_lon"], (s["dlon"] * s["m_lon"]).alias("ab_x"), s["ab_y"]),
    )
    sized = F.transform(
        vector, lambda s: F.struct(s.alias("v"), (s["ab_x"] * s["ab_x"] + s["ab_y"] * s["ab_y"]).alias("len2"))
    )
    init = F.struct(F.lit(0.0).alias("run"), F.expr("cast(array() as array<double>)").alias("starts"))
    starts = F.aggregate(
        "_sized",
        init,
        lambda acc, s: F.struct(
            (acc["run"] + F.sqrt(s["len2"])).alias("run"),
            F.concat(acc["starts"], F.array(acc["run"])).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    segs = F.transform(
        "_sized",
        lambda s, i: F.struct(
            i.alias("seg_no"),
            s["v"]["lat0"].alias("lat0"),
            s["v"]["lon0"].alias("lon0"),
            s["v"]["m_lon"].alias("m_lon"),
            s["v"]["ab_x"].alias("ab_x"),
            s["v"]["ab_y"].alias("ab_y"),
            s["len2"].alias("len2"),
            F.when(s["len2"] > geo.MIN_SEGMENT_SQUARED_M, s["len2"]).otherwise(1.0).alias("safe_len2"),
            F.sqrt(s["len2"]).alias("len_m"),
            F.get("_starts", i).alias("cum_m"),
        ),
    )
    return (
        shapes.withColumn("_sized", sized)
        .withColumn("_starts", starts)
        .select(
            "line",
            "branch_pos",
            "shape_id",
            "short_name",
            "name",
            "direction",
            segs.alias("segs"),
            F.aggregate("_sized", F.lit(0.0), lambda a, s: a + F.sqrt(s["len2"])).alias("planar_m"),
            path_length(pts).alias("length_m"),
        )
    )


def project_points(
    points: DataFrame, paths: DataFrame, on: list[str], keep: list[str] | None = None, segment: bool = False
) -> DataFrame:
    """Join each point to the prepared path(s) sharing ``on`` and add along_m, offset_m (and seg_no)."""
    extra = [c for c in (keep or ["length_m"]) if c not in on]
    joined = points.join(small(paths.select(*on, "segs", *extra)), on)
    hit = geo.nearest_on_path(F.col("lat"), F.col("lon"), F.col("segs"))
    # generated, not projected: a later filter on the offset must not evaluate the search a second time
    found = joined.select(*[c for c in joined.columns if c != "segs"], F.inline(F.array(hit)))
    return found.withColumn("offset_m", F.sqrt("err2")).drop("err2", *([] if segment else ["seg_no"]))


CELL_DEG = 0.002


def path_cells(paths: DataFrame, on: list[str], keep: list[str], limit_m: float, cell: float = CELL_DEG) -> DataFrame:
    """Segments of each shape by grid cell: a cell lists every segment that can be within the limit of a point in it."""
    extra = [c for c in dict.fromkeys(["shape_id", *keep]) if c not in on]
    s = F.col("s")
    lat1, lon1 = s["lat0"] + s["ab_y"] / geo.METRES_PER_DEGREE, s["lon0"] + s["ab_x"] / s["m_lon"]
    # a hair of slack, so that rounding never loses a segment exactly on the limit
    dy, dx = F.lit(limit_m / geo.METRES_PER_DEGREE + 1e-7), F.lit(limit_m) / s["m_lon"] + 1e-7
    low = lambda a, b, d: F.floor((F.least(a, b) - d) / cell)
    high = lambda a, b, d: F.floor((F.greatest(a, b) + d) / cell)
    segs = paths.select(*on, *extra, F.explode("segs").alias("s"))
    rows = segs.select(*on, *extra, "s", F.explode(F.sequence(low(s["lat0"], lat1, dy), high(s["lat0"], lat1, dy))).alias("_cy"))
    cells = rows.select(*on, *extra, "s", "_cy", F.explode(F.sequence(low(s["lon0"], lon1, dx), high(s["lon0"], lon1, dx))).alias("_cx"))
    return cells.groupBy(*on, *extra, "_cy", "_cx").agg(F.collect_list("s").alias("segs"))


def project_near(
    points: DataFrame, paths: DataFrame, on: list[str], keep: list[str] | None = None, limit_m: float = geo.MAX_OFFSET_M
) -> DataFrame:
    """``near_path(project_points(...))`` through a grid: points beyond the limit are not compared at all.

    A point meets only the segments listed in its cell, a handful instead of
    the whole path, and a shape used by many points is spread over its cells.
    The nearest segment of a point within the limit is always in its cell.
    """
    extra = [c for c in (keep or ["length_m"]) if c not in on]
    cells = path_cells(paths, on, extra, limit_m)
    here = points.withColumns({"_cy": F.floor(F.col("lat") / CELL_DEG), "_cx": F.floor(F.col("lon") / CELL_DEG)})
    listed = cells if "shape_id" in [*on, *extra] else cells.drop("shape_id")
    joined = here.join(small(listed), [*on, "_cy", "_cx"])
    hit = geo.nearest_on_path(F.col("lat"), F.col("lon"), F.col("segs"))
    found = joined.select(*[c for c in joined.columns if c not in ("segs", "_cy", "_cx")], F.inline(F.array(hit)))
    return near_path(found.withColumn("offset_m", F.sqrt("err2")).drop("err2", "seg_no"), limit_m)


def near_path(projected: DataFrame, max_offset_m: float = geo.MAX_OFFSET_M) -> DataFrame:
    return projected.where(F.col("offset_m") <= max_offset_m)


def fallback_shapes(paths: DataFrame) -> DataFrame:
    """(line, direction) → shape of the last branch in file order."""
    return paths.groupBy("line", F.coalesce("direction", F.lit(0)).alias("trip_direction_id")).agg(
        F.max_by("shape_id", "branch_pos").alias("fallback_shape")
    )


def assign_shape(points: DataFrame, branch_map: DataFrame, paths: DataFrame) -> DataFrame:
    """Add shape_id (mapped route or line fallback) and mapped flag; rows without any shape leave.

    Joins on the trip's route and direction against two small maps; no shuffle
    of the points.
    """
    known = paths.select(F.col("shape_id").alias("mapped_shape")).distinct()
    exact = (
        branch_map.groupBy(
            F.col("route_id").alias("trip_route_id"), F.col("direction_id").alias("trip_direction_id")
        )
        .agg(F.max("shape_id").alias("mapped_shape"))
        .join(known, "mapped_shape", "left_semi")
    )
    lines = paths.select("line").distinct()
    return (
        points.join(small(lines), "line", "left_semi")
        .join(small(exact), ["trip_route_id", "trip_direction_id"], "left")
        .join(small(fallback_shapes(paths)), ["line", "trip_direction_id"], "left")
        .withColumn("shape_id", F.coalesce("mapped_shape", "fallback_shape"))
        .withColumn("mapped", F.col("mapped_shape").isNotNull())
        .where("shape_id is not null")
        .drop("mapped_shape", "fallback_shape")
    )


def best_branch(locations: DataFrame, paths: DataFrame, keys: list[str], max_offset_m: float = geo.MAX_OFFSET_M) -> DataFrame:
    """The nearest branch of the location's line; the first one on ties; none beyond the limit.

    ``keys`` identify a location together with its line.
    """
    hits = project_near(locations, paths, ["line"], ["shape_id", "name", "direction", "branch_pos", "length_m"], max_offset_m)
    chosen = F.min_by(
        F.struct("shape_id", "name", F.coalesce("direction", F.lit(0)).alias("direction"), "along_m", "offset_m", "length_m"),
        F.struct("offset_m", "branch_pos"),
    )
    return (
        hits.groupBy(*keys, "line").agg(chosen.alias("b")).select(*keys, "line", "b.*")
    )


def project_fleet(live: DataFrame, branches: DataFrame, paths: DataFrame, max_offset_m: float = geo.MAX_OFFSET_M) -> DataFrame:
    """Live vehicles on the given branches (line, shape_id) of their line."""
    wanted = branches.select("line", "shape_id").distinct()
    return project_near(live.join(small(wanted), "line"), paths, ["shape_id"], ["length_m"], max_offset_m)


def best_branch_per_trip(
    points: DataFrame, paths: DataFrame, max_offset_m: float = geo.MAX_OFFSET_M, min_points: int = 3, min_span_m: float = 200.0
) -> DataFrame:
    """Per trip the branch with most points strictly inside the limit; earliest branch on ties.

    Candidates are the branches of the trip's direction. Only per-trip counters
    are shuffled, with partial aggregation.
    """
    hits = project_near(
        points.withColumn("direction", F.col("trip_direction_id")), paths, ["line", "direction"], ["shape_id", "branch_pos", "length_m"], max_offset_m
    ).where(F.col("offset_m") < max_offset_m)
    per_branch = hits.groupBy("vehicle_id", "trip_no", "shape_id", "branch_pos", "length_m").agg(
        F.count(F.lit(1)).alias("n_near"), (F.max("along_m") - F.min("along_m")).alias("span_m")
    )
    return (
        per_branch.groupBy("vehicle_id", "trip_no")
        .agg(F.max_by(F.struct("shape_id", "n_near", "span_m", "length_m"), F.struct("n_near", -F.col("branch_pos"))).alias("b"))
        .select("vehicle_id", "trip_no", "b.*")
        .where((F.col("n_near") >= min_points) & (F.col("span_m") >= min_span_m))
    )


def shape_for(shapes: DataFrame) -> DataFrame:
    """First branch of every (line, direction)."""
    return (
        shapes.where("direction is not null")
        .groupBy("line", "direction")
        .agg(F.min_by(F.struct("shape_id", "points"), "branch_pos").alias("s"))
        .select("line", "direction", "s.*")
    )


def branch_entries(shapes: DataFrame, families: DataFrame) -> DataFrame:
    """Direction by order of appearance of the short name, short-turn flag, parent and key."""
    seen = Window.partitionBy("line", "short_name").orderBy("branch_pos")
    # one parent per short turn: the last family listed wins
    parents = families.groupBy("line", F.col("child").alias("short_name")).agg(F.max("parent").alias("parent"))
    return (
        shapes.withColumn("entry_direction", (F.row_number().over(seen) - 1).cast("int"))
        .join(small(parents), ["line", "short_name"], "left")
        .withColumn("is_short_turn", F.col("parent").isNotNull())
        .withColumn("shape_key", F.concat(F.col("short_name"), F.lit("-d"), F.col("entry_direction").cast("string")))
    )


def derived_direction(shapes: DataFrame) -> DataFrame:
    """Fill a missing direction from the order of appearance of the short name."""
    seen = Window.partitionBy("line", "short_name").orderBy("branch_pos")
    return shapes.withColumn("direction", F.coalesce("direction", (F.row_number().over(seen) - 1).cast("int")))


def shape_stats(shapes: DataFrame) -> DataFrame:
    """Points, stops and named stops per branch; colour without '#', lower case."""
    return shapes.select(
        "line",
        "branch_pos",
        "shape_id",
        F.lower(F.regexp_replace(F.coalesce("color", F.lit("")), "^#+", "")).alias("color"),
        F.size("points").alias("n_points"),
        F.coalesce(F.size("stops"), F.lit(0)).alias("n_stops"),
        F.coalesce(F.size(F.filter("stops", lambda s: F.coalesce(s["name"], F.lit("")) != "")), F.lit(0)).alias("n_named"),
    )


def line_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("line").agg(
        F.count(F.lit(1)).alias("n_branches"), F.sum("n_points").alias("n_points"), F.sum("n_stops").alias("n_stops")
    )


def truncate_shapes(shapes: DataFrame, rules: DataFrame) -> DataFrame:
    """Replace earlier short turns by freshly cut ones.

    ``rules``: base_shape, short_name, keep ('tail'|'head'), stop_id, find, replace.
    The path is cut at the vertex nearest to the named stop, both sides inclusive.
    """
    base = shapes.where(~F.col("shape_id").startswith("frac_"))
    r = rules.select(
        F.col("base_shape").alias("shape_id"),
        F.col("short_name").alias("_short"),
        "keep",
        "stop_id",
        "find",
        "replace",
    )
    found = base.join(small(r), "shape_id").withColumn(
        "_stop_at", F.array_position(F.transform("stops", lambda s: s["id"]), F.col("stop_id")).cast("int")
    )
    stop = F.get("stops", F.col("_stop_at") - 1)
    found = found.where("_stop_at > 0").withColumn("_lat", stop["lat"]).withColumn("_lng", stop["lng"])
    cut = F.array_min(
        F.transform("points", lambda p, i: F.struct(geo.equirect_m(p["lat"], p["lon"], F.col("_lat"), F.col("_lng")).alias("d"), i.alias("i")))
    )["i"]
    tail = F.col("keep") == "tail"
    made = found.withColumn("_cut", cut).select(
        "line",
        "color",
        F.col("branch_pos"),
        F.concat(F.lit("frac_"), "shape_id").alias("shape_id"),
        F.col("_short").alias("short_name"),
        F.replace("name", F.col("find"), F.col("replace")).alias("name"),
        "direction",
        F.when(tail, F.slice("points", F.col("_cut") + 1, F.size("points"))).otherwise(F.slice("points", F.lit(1), F.col("_cut") + 1)).alias("points"),
        F.when(tail, F.slice("stops", F.col("_stop_at"), F.size("stops"))).otherwise(F.slice("stops", F.lit(1), F.col("_stop_at"))).alias("stops"),
    )
    last = base.groupBy("line").agg(F.max("branch_pos").alias("_last"))
    order = Window.partitionBy("line").orderBy("short_name", "shape_id")
    made = (
        made.withColumn("_k", F.row_number().over(order))
        .join(small(last), "line")
        .withColumn("branch_pos", (F.col("_last") + F.col("_k")).cast("int"))
        .drop("_last", "_k")
    )
    return base.unionByName(made.select(*base.columns))


def projection_quality(projected: DataFrame, groups: list[str], limit_m: float = geo.MAX_OFFSET_M) -> DataFrame:
    """Vehicles, points, P50/P90 of the offset by index, share beyond the limit and verdict."""
    q = exact_quantiles(projected, groups, "offset_m", {"p50_m": 0.5, "p90_m": 0.9}, width=1.0, method="index")
    vehicles = projected.groupBy(*groups, "vehicle_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("offset_m") > limit_m, 1).otherwise(0)).alias("_far")
    )
    counts = vehicles.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_vehicles"),
        F.sum("_n").alias("n_points"),
        (F.sum("_far") * 100.0 / F.sum("_n")).alias("pct_over_150"),
    )
    joined = counts.join(q, groups) if groups else counts.crossJoin(q)
    return joined.withColumn("ok", F.col("p90_m") <= limit_m)
