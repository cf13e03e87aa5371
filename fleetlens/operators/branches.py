"""Resolving route ids to physical branches from GPS evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import geo
from fleetlens.operators.geometry import branch_entries, prepared_paths
from fleetlens.operators.scale import exact_quantiles, exact_quantiles_by_day, small

# fixed values
CONTAINED_M = 30.0
CONTAINMENT_MIN = 0.60
VOTE_MARGIN = 0.15
VOTE_TIE_M = 3.0
HIGH_QUANTILE = 0.95
QUANTILE_MARGIN = 0.40
COVERAGE_GAP = 0.15
SHORT_TURN_MARGIN = 0.05
MIN_TRIPS = 3
RETIRE_DAYS = 7
FIRST_WAVE = 8

ROUTE = ["line", "route_id"]


def scan_route_ids(obs: DataFrame, tie: str = "event_id") -> DataFrame:
    """First direction seen per (day, line, route)."""
    seen = obs.where("line is not null and coalesce(route_id, '') <> ''")
    return seen.groupBy("day", *ROUTE).agg(F.min_by("direction_id", F.struct("ts", tie)).alias("direction_id"))


def trip_days(points: DataFrame) -> DataFrame:
    """One row per trip of a line with a route: the day of its first point counts for the whole trip."""
    return points.where("point_no = 0 and line is not null and coalesce(trip_route_id, '') <> ''").select(
        "line",
        F.col("trip_route_id").alias("route_id"),
        "vehicle_id",
        "trip_no",
        F.col("trip_direction_id").alias("direction_id"),
        "trip_start_ts",
        "n_points",
        F.col("day").alias("trip_day"),
    )


def route_evidence(trips: DataFrame) -> DataFrame:
    """Trips, points, last direction, first and last day per route; the points themselves stay rows."""
    latest = F.struct("trip_start_ts", "vehicle_id", "trip_no")
    return trips.groupBy(*ROUTE).agg(
        F.count(F.lit(1)).alias("n_trips"),
        F.sum("n_points").alias("n_points"),
        F.max_by("direction_id", latest).alias("direction_id"),
        F.min("trip_day").alias("first_day"),
        F.max("trip_day").alias("last_day"),
    )


def candidates(shapes: DataFrame, families: DataFrame) -> DataFrame:
    """Per (line, direction) the list of its branches with prepared paths; bounded by the line's branches."""
    entries = branch_entries(shapes, families).select(
        "line", "shape_id", F.col("entry_direction").alias("direction_id"), "shape_key", "short_name", "name", "is_short_turn", "parent", "branch_pos"
    )
    body = entries.join(small(prepared_paths(shapes).select("shape_id", "segs", "planar_m")), "shape_id")
    one = F.struct("branch_pos", "shape_key", "short_name", "shape_id", "name", "is_short_turn", "parent", "planar_m", "segs")
    return body.groupBy("line", "direction_id").agg(F.array_sort(F.collect_list(one)).alias("cands"))


def candidate_projection(points: DataFrame, evidence: DataFrame, cands: DataFrame, tol: float = VOTE_TIE_M, contained_m: float = CONTAINED_M) -> DataFrame:
    """One row per (point, candidate branch): offset, distance along, its share of the point's vote.

    All candidates of a point are projected inside its row, so the vote needs
    no shuffle; only the aggregates that follow do.
    """
    rows = points.select("line", F.col("trip_route_id").alias("route_id"), *[c for c in ("trip_day",) if c in points.columns], "lat", "lon")
    # the route's direction first, then the candidates of (line, direction): paths are never copied per route
    joined = rows.join(small(evidence.select(*ROUTE, "direction_id")), ROUTE).join(small(cands), ["line", "direction_id"])

    def hit(c: Column) -> Column:
        h = geo.nearest_on_path(F.col("lat"), F.col("lon"), c["segs"])
        return F.struct(c["shape_key"].alias("shape_key"), F.sqrt(h["err2"]).alias("offset_m"), h["along_m"].alias("along_m"))

    hits = joined.select(*[c for c in rows.columns if c not in ("lat", "lon")], F.inline(F.array(F.struct(F.transform("cands", hit).alias("hits")))))
    best = F.array_min(F.transform("hits", lambda h: h["offset_m"]))
    hits = hits.withColumn("_best", best).withColumn("_n", F.size(F.filter("hits", lambda h: h["offset_m"] <= F.col("_best") + tol)))
    each = hits.select(*[c for c in hits.columns if c not in ("hits",)], F.inline("hits"))
    return each.select(
        *[c for c in rows.columns if c not in ("lat", "lon")],
        "shape_key",
        "offset_m",
        "along_m",
        F.when(F.col("offset_m") <= F.col("_best") + tol, F.lit(1.0) / F.col("_n")).otherwise(0.0).alias("vote"),
        F.when(F.col("offset_m") < contained_m, 1.0).otherwise(0.0).alias("contained"),
    )


BY_SHAPE = [*ROUTE, "shape_key"]


def vote_fractions(proj: DataFrame) -> DataFrame:
    """Mean vote of the route's points per candidate."""
    return proj.groupBy(*BY_SHAPE).agg((F.sum("vote") / F.count(F.lit(1))).alias("vote_frac"))


def containment(proj: DataFrame) -> DataFrame:
    return proj.groupBy(*BY_SHAPE).agg(F.avg("contained").alias("containment"))


def coverage(proj: DataFrame, lengths: DataFrame) -> DataFrame:
    """(p98 − p2 of the distance along) / path length. ``lengths``: line, shape_key, planar_m."""
    q = exact_quantiles(proj, BY_SHAPE, "along_m", {"p2": 0.02, "p98": 0.98}, width=10.0)
    return q.join(small(lengths), ["line", "shape_key"]).select(
        *BY_SHAPE, F.when(F.col("planar_m") > 0, (F.col("p98") - F.col("p2")) / F.col("planar_m")).otherwise(0.0).alias("coverage")
    )


def error_quantile(proj: DataFrame, p: float = HIGH_QUANTILE) -> DataFrame:
    return exact_quantiles(proj, BY_SHAPE, "offset_m", {"q_high_m": p}, width=1.0)


def branch_lengths(cands: DataFrame) -> DataFrame:
    return cands.select("line", F.explode("cands").alias("c")).select("line", "c.shape_key", "c.planar_m")


def branch_table(cands: DataFrame) -> DataFrame:
    return cands.select("line", "direction_id", F.explode("cands").alias("c")).select(
        "line", "direction_id", "c.branch_pos", "c.shape_key", "c.short_name", "c.shape_id", "c.name", "c.is_short_turn", "c.parent"
    )


SPREAD = {"p2": 0.02, "p98": 0.98, "high": HIGH_QUANTILE}
SPREAD_WIDTH = 5.0


def _measures(proj: DataFrame) -> DataFrame:
    """Distance along and offset as (measure, value) rows, so that one quantile pass serves both."""
    pair = lambda name: F.struct(F.lit(name).alias("measure"), F.col(name).alias("value"))
    keys = [c for c in proj.columns if c in (*BY_SHAPE, "trip_day", "day_no")]
    return proj.select(*keys, F.inline(F.array(pair("along_m"), pair("offset_m"))))


def _spread(q: DataFrame, keys: list[str], lengths: DataFrame) -> DataFrame:
    """coverage and q_high_m per key from the quantiles of both measures."""
    of = lambda name, c: F.max(F.when(F.col("measure") == name, c))
    wide = q.groupBy(*keys).agg(
        of("along_m", F.col("p98") - F.col("p2")).alias("_range"), of("offset_m", F.col("high")).alias("q_high_m")
    )
    full = F.when(F.col("planar_m") > 0, F.col("_range") / F.col("planar_m")).otherwise(0.0)
    return wide.join(small(lengths), ["line", "shape_key"]).withColumn("coverage", full).drop("_range", "planar_m")


def candidate_scores(proj: DataFrame, cands: DataFrame) -> DataFrame:
    """All four measures per (route, candidate)."""
    plain = proj.groupBy(*BY_SHAPE).agg(
        (F.sum("vote") / F.count(F.lit(1))).alias("vote_frac"), F.avg("contained").alias("containment")
    )
    q = exact_quantiles(_measures(proj), [*BY_SHAPE, "measure"], "value", SPREAD, width=SPREAD_WIDTH)
    scored = plain.join(_spread(q, BY_SHAPE, branch_lengths(cands)), BY_SHAPE)
    return scored.join(small(branch_table(cands)), ["line", "shape_key"])


def top_candidates(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rounded diagnostics per route, best p95 first. A list holds at most the line's branches."""
    keys = keys or ROUTE
    row = F.struct(
        F.round("q_high_m", 1).alias("q_high_m"),
        F.col("branch_pos"),
        F.col("shape_key").alias("key"),
        F.round("containment", 3).alias("containment"),
        F.round("coverage", 3).alias("coverage"),
        F.round("vote_frac", 3).alias("vote_frac"),
        F.col("is_short_turn"),
    )
    return scores.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("top_candidates"))


def resolve_routes(
    evidence: DataFrame,
    scores: DataFrame,
    directions: DataFrame,
    keys: list[str] | None = None,
    containment_min: float = CONTAINMENT_MIN,
    vote_margin: float = VOTE_MARGIN,
    quantile_margin: float = QUANTILE_MARGIN,
    coverage_gap: float = COVERAGE_GAP,
    short_turn_margin: float = SHORT_TURN_MARGIN,
    min_trips: int = MIN_TRIPS,
) -> DataFrame:
    """Decide per route: resolved or pending, with reason, branch, method and margins.

    ``evidence``: keys, line, direction_id, n_trips, n_points; ``scores``: keys
    and the candidate measures; ``directions``: (line, direction_id) that have
    branches at all.
    """
    keys = keys or ROUTE
    cand = F.struct(
        "branch_pos", "shape_key", "short_name", "shape_id", "name", "is_short_turn", "parent",
        "containment", "coverage", "vote_frac", "q_high_m", (F.col("coverage") * F.col("containment")).alias("score"),
    )
    lists = scores.groupBy(*keys).agg(F.collect_list(cand).alias("c"))
    known = directions.select("line", "direction_id").distinct().withColumn("_has", F.lit(True))
    t = evidence.join(small(known), ["line", "direction_id"], "left").join(lists, keys, "left")

    # rankings by one measure; the earlier branch wins a tie
    def ranked(arr: Column, measure: str, descending: bool) -> Column:
        sign = -1 if descending else 1
        return F.array_sort(F.transform(arr, lambda x: F.struct((x[measure] * sign).alias("k"), x["branch_pos"].alias("p"), x.alias("x"))))

    high = F.filter("c", lambda x: x["containment"] >= containment_min)
    t = t.withColumn("_high", F.coalesce(high, F.array().cast(lists.schema["c"].dataType)))
    first = lambda arr: F.get(arr, F.lit(0))["x"]
    second = lambda arr: F.get(arr, F.lit(1))["x"]
    t = t.withColumns({"_cov": ranked(F.col("_high"), "score", True), "_vote": ranked(F.col("_high"), "vote_frac", True), "_q": ranked(F.col("_high"), "q_high_m", False)})
    t = t.withColumns({"w": first(F.col("_cov")), "v1": first(F.col("_vote")), "v2": second(F.col("_vote")), "q1": first(F.col("_q")), "q2": second(F.col("_q"))})
    rival = F.array_max(
        F.transform(F.filter("_high", lambda x: x["is_short_turn"] & (x["shape_key"] != F.col("w.shape_key"))), lambda x: x["score"])
    )
    family_margin = F.when(rival.isNull(), 1.0).when(F.col("w.score") > 0, (F.col("w.score") - rival) / F.col("w.score")).otherwise(0.0)
    parent_cov = F.coalesce(
        F.get(F.filter("c", lambda x: x["short_name"] == F.col("w.parent")), F.lit(0))["coverage"], F.lit(0.0)
    )
    gap = F.when(F.col("w.coverage") > 0, (F.col("w.coverage") - parent_cov) / F.col("w.coverage")).otherwise(0.0)
    q_second = F.coalesce("q2.q_high_m", "q1.q_high_m")
    t = t.withColumns(
        {
            "_family": family_margin,
            "_gap": gap,
            "_vm": F.col("v1.vote_frac") - F.coalesce("v2.vote_frac", F.lit(0.0)),
            "_qm": F.when(q_second > 0, (q_second - F.col("q1.q_high_m")) / q_second).otherwise(0.0),
        }
    )
    vote_ok, q_ok = F.col("_vm") >= vote_margin, F.col("_qm") >= quantile_margin
    winner = F.when(vote_ok & (F.col("v1.shape_key") == F.col("q1.shape_key")), F.col("v1")).when(q_ok, F.col("q1")).otherwise(F.col("v1"))
    short = F.col("w.is_short_turn")
    reason = (
        F.when(F.col("n_trips") < min_trips, "cold_start")
        .when(F.col("_has").isNull(), "no_shapes_for_direction")
        .when(F.col("n_points") == 0, "no_points")
        .when(F.size("_high") == 0, "no_high_containment")
        .when(short & (F.col("_family") < short_turn_margin), "ambiguous_fraccionado_family")
        .when(short & (F.col("_gap") < coverage_gap), "ambiguous_fraccionado")
        .when(~short & ~(vote_ok | q_ok), "ambiguous_completo")
    )
    t = t.withColumn("reason", reason).withColumn("_win", F.when(F.col("reason").isNull(), F.when(short, F.col("w")).otherwise(winner)))
    resolved = F.col("reason").isNull()
    parts = F.concat_ws(
        "+", F.when(vote_ok, "vote"), F.when(q_ok, "q95"), F.when(F.col("_win.shape_key") == F.col("w.shape_key"), "cov")
    )
    decided = F.col("reason").isNull() | F.col("reason").startswith("ambiguous")
    only = lambda cond, c: F.when(decided & cond, c).otherwise(F.lit(0.0))
    return t.select(
        *keys,
        *[c for c in ("line", "direction_id") if c not in keys],
        F.when(resolved, "resolved").otherwise("pending").alias("status"),
        "reason",
        F.col("_win.shape_key").alias("shape_key"),
        F.col("_win.short_name").alias("short_name"),
        F.col("_win.shape_id").alias("shape_id"),
        F.col("_win.name").alias("name"),
        F.when(resolved, F.col("direction_id")).alias("shape_direction"),
        F.when(resolved, F.when(short, "fraccionado").otherwise("completo")).alias("assignment_type"),
        F.when(resolved, F.when(short, "coverage_gap").otherwise(parts)).alias("method"),
        F.when(resolved, F.when(short, F.col("_gap")).otherwise(F.greatest("_vm", "_qm"))).otherwise(0.0).alias("confidence"),
        F.when(resolved & short, F.col("w.vote_frac")).otherwise(only(~short, F.col("_vm"))).alias("vote_margin"),
        only(~short, F.col("_qm")).alias("quantile_margin"),
        only(~short, F.col("q1.q_high_m")).alias("q_best_m"),
        F.when(resolved, F.col("w.coverage")).otherwise(0.0).alias("coverage_winner_val"),
        F.when(resolved, F.col("_win.containment")).otherwise(0.0).alias("containment_winner_val"),
        only(short, F.col("_family")).alias("fraccionado_score_margin"),
        F.when(decided & short & (F.coalesce("reason", F.lit("")) != "ambiguous_fraccionado_family"), F.col("_gap")).otherwise(0.0).alias("coverage_gap_relative"),
        F.col("n_trips").alias("total_trips"),
        F.col("n_points").alias("total_points"),
    )


def pending_spans(trips: DataFrame, days: DataFrame, retire_days: int = RETIRE_DAYS) -> DataFrame:
    """Per route: first day, the last active day before retirement, and whether it retired.

    ``days``: trip_day, day_no of every processed day. A route is retired after
    ``retire_days`` processed days without a trip and does not come back.
    """
    calendar = days.select(F.col("trip_day"), "day_no")
    active = trips.select(*ROUTE, "trip_day").distinct().join(small(calendar), "trip_day")
    ordered = Window.partitionBy(*ROUTE).orderBy("day_no")
    end = days.agg(F.max("day_no").alias("_end")).withColumn("_k", F.lit(0))
    gaps = (
        active.withColumn("_next", F.lead("day_no").over(ordered))
        .withColumn("_k", F.lit(0))
        .join(small(end), "_k")
        .withColumn("_retires", (F.coalesce("_next", F.col("_end") + 1) - F.col("day_no") - 1) >= retire_days)
    )
    return gaps.groupBy(*ROUTE).agg(
        F.min("day_no").alias("first_no"),
        F.max("day_no").alias("last_no"),
        F.coalesce(F.min(F.when(F.col("_retires"), F.col("day_no"))), F.max("day_no")).alias("until_no"),
        F.max("_retires").alias("retires"),
        F.max((F.col("day_no") == F.col("_end"))).alias("on_last_day"),
    )


def resolve_lifecycle(
    points: DataFrame, days: DataFrame, shapes: DataFrame, families: DataFrame, store, contained_m: float = CONTAINED_M, tol: float = VOTE_TIE_M,
    retire_days: int = RETIRE_DAYS, **thresholds,
) -> DataFrame:
    """Branch map over a recording: each route's branch at the first day its evidence suffices.

    Evidence starts on the day after a route is first seen and ends at its
    retirement. Days with new evidence are judged in waves, the first 8 of a route that has
    trips enough, then the next 24, the next 96 and so on, each only for routes still open; the
    earliest success counts. A wave adds up the days before it at once, so no day after a route's resolution
    is judged beyond its wave and the rows read stay below 4/3 of the evidence. ``points``
    are trip points; ``days`` holds trip_day and day_no; ``store`` writes an
    intermediate table to shared storage.
    """
    trips = store(trip_days(points), "trip-days")
    spans = store(pending_spans(trips, days, retire_days), "spans")
    calendar = days.select("trip_day", "day_no")
    dated = trips.join(small(calendar), "trip_day")
    openings = (
        dated.join(small(spans.select(*ROUTE, "first_no")), ROUTE)
        .where("day_no = first_no")
        .groupBy(*ROUTE)
        .agg(F.max_by("direction_id", F.struct("trip_start_ts", "vehicle_id", "trip_no")).alias("direction_id"))
    )
    cands = candidates(shapes, families)
    window = spans.select(*ROUTE, "first_no", "until_no")
    used = dated.join(small(window), ROUTE).where("day_no > first_no and day_no <= until_no")
    keyed = points.drop("day").join(
        used.select("vehicle_id", "trip_no", "day_no"), ["vehicle_id", "trip_no"]
    ).withColumnRenamed("day_no", "trip_day")
    proj = store(candidate_projection(keyed, openings, cands, tol, contained_m), "evidence")

    daily = used.groupBy(*ROUTE, "day_no").agg(F.count(F.lit(1)).alias("_t"), F.sum("n_points").alias("_p"))
    by_route = Window.partitionBy(*ROUTE).orderBy("day_no").rowsBetween(Window.unboundedPreceding, 0)
    evidence = daily.select(*ROUTE, "day_no", F.sum("_t").over(by_route).alias("n_trips"), F.sum("_p").over(by_route).alias("n_points"))
    evidence = evidence.where(F.col("n_trips") >= thresholds.get("min_trips", MIN_TRIPS)).withColumn("_turn", F.row_number().over(by_route))
    evidence = store(evidence.join(openings, ROUTE), "turns")

    solved, low, high = None, 1, FIRST_WAVE
    still_open = evidence
    while solved is None or not still_open.isEmpty():
        found = store(_first_success(proj, still_open.where(F.col("_turn") <= high).drop("_turn"), cands, thresholds), "solved")
        solved = found if solved is None else solved.unionByName(found)
        low, high = high + 1, 4 * high
        still_open = evidence.where(F.col("_turn") >= low).join(solved.select(*ROUTE), ROUTE, "left_anti")
    name_of = lambda c: small(days.select(F.col("day_no").alias(f"{c}_no"), F.col("trip_day").alias(c)))
    out = (
        spans.join(openings, ROUTE)
        .join(solved, ROUTE, "left")
        .withColumn("seen_no", F.when(F.col("resolved_no").isNotNull(), F.col("last_no")).otherwise(F.col("until_no")))
    )
    is_solved = F.col("resolved_no").isNotNull()
    out = out.withColumn("assignment_status", F.when(is_solved, "resolved").when(F.col("retires"), "unresolved").otherwise("pending")).withColumn(
        "status", F.when((is_solved | ~F.col("retires")) & F.col("on_last_day"), "active").otherwise("retired")
    )
    out = out.withColumnRenamed("first_no", "first_seen_no").withColumnRenamed("seen_no", "last_seen_no").withColumnRenamed("resolved_no", "resolved_on_no")
    out = out.join(name_of("first_seen"), "first_seen_no").join(name_of("last_seen"), "last_seen_no").join(name_of("resolved_on"), "resolved_on_no", "left")
    return out.select(
        *ROUTE, "direction_id", "first_seen", "last_seen", "resolved_on", "status", "assignment_status", "shape_key", "short_name",
        "shape_id", "name", "confidence", "method", "assignment_type",
    )


def _first_success(proj: DataFrame, wave: DataFrame, cands: DataFrame, thresholds: dict) -> DataFrame:
    """Routes resolved on a day of ``wave`` (route and day_no with the evidence up to it), judged on everything up to that day."""
    span = wave.groupBy(*ROUTE).agg(F.min("day_no").alias("_first"), F.max("day_no").alias("_last"))
    rows = proj.join(small(span), ROUTE).where("trip_day <= _last")
    rows = rows.withColumn("day_no", F.greatest("trip_day", "_first")).drop("trip_day", "_first", "_last")
    counters = rows.groupBy(*BY_SHAPE, "day_no").agg(F.sum("vote").alias("_v"), F.sum("contained").alias("_c"), F.count(F.lit(1)).alias("_n"))
    by_shape = Window.partitionBy(*BY_SHAPE).orderBy("day_no").rowsBetween(Window.unboundedPreceding, 0)
    plain = counters.select(
        *BY_SHAPE,
        "day_no",
        (F.sum("_v").over(by_shape) / F.sum("_n").over(by_shape)).alias("vote_frac"),
        (F.sum("_c").over(by_shape) / F.sum("_n").over(by_shape)).alias("containment"),
    )
    q = exact_quantiles_by_day(_measures(rows), [*BY_SHAPE, "measure"], "day_no", "value", SPREAD, width=SPREAD_WIDTH)
    by_day = [*BY_SHAPE, "day_no"]
    spread = _spread(q, by_day, branch_lengths(cands))
    scores = plain.join(spread, by_day).join(small(branch_table(cands).drop("direction_id")), ["line", "shape_key"])
    verdicts = resolve_routes(wave, scores, cands, [*ROUTE, "day_no"], **thresholds)
    first = F.min_by(F.struct(F.col("day_no").alias("resolved_no"), "shape_key", "short_name", "shape_id", "name", "confidence", "method", "assignment_type"), "day_no")
    return verdicts.where("status = 'resolved'").groupBy(*ROUTE).agg(first.alias("s")).select(*ROUTE, "s.*")


def resolution_summary(result: DataFrame, cands: DataFrame) -> DataFrame:
    """Long report: totals, resolved per branch and method, pending per reason, branches without a route."""
    totals = result.groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status") == "resolved", 1).otherwise(0)).alias("ok")
    )
    rate = F.round(F.col("ok") * 100.0 / F.col("n"), 1)
    head = totals.select(
        "line", F.explode(F.array(
            F.struct(F.lit("total").alias("section"), F.lit("").alias("key"), F.lit("").alias("detail"), F.col("n").alias("n"), F.lit(100.0).alias("pct")),
            F.struct(F.lit("resolved").alias("section"), F.lit("").alias("key"), F.lit("").alias("detail"), F.col("ok").alias("n"), rate.alias("pct")),
        )).alias("x")
    ).select("line", "x.*")
    groups = lambda df, section, key, detail: df.groupBy("line", key.alias("key"), detail.alias("detail")).agg(
        F.count(F.lit(1)).alias("n")
    ).select("line", F.lit(section).alias("section"), "key", "detail", "n", F.lit(None).cast("double").alias("pct"))
    done = groups(result.where("status = 'resolved'"), "branch", F.col("shape_key"), F.concat_ws(":", "assignment_type", "method"))
    wait = groups(result.where("status = 'pending'"), "pending", F.col("reason"), F.lit(""))
    free = branch_table(cands).join(result.where("status = 'resolved'").select("line", "shape_key"), ["line", "shape_key"], "left_anti")
    return head.unionByName(done).unionByName(wait).unionByName(groups(free, "uncovered", F.col("shape_key"), F.lit("")))
