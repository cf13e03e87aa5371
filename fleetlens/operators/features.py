"""ETA training features.

Point features (history, fleet, previous bus) are built once per point; pairs
are formed last and carry arrays only if asked to. Trips are handled in blocks
of consecutive points, so a very long trip spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.calendar import day_angle, monday_weekday
from fleetlens.functions.values import clip, finite_or_zero, stable_order
from fleetlens.operators.scale import HOUR_S, bracketing_neighbours, bucket, exact_quantiles, number_rows, running_total, small

# fixed values
SEGMENT_M = 500.0
MIN_AHEAD_M = 100.0
HISTORY = 10
FLEET_CAP = 60
FLEET_WIDTH = 5
FLEET_CENTRE = (-34.6, -58.4)
MAX_AGE_S = 600
KEEP_TRIPS = 10
NEAR_PING_M = 250.0
PASSAGE_CAP_S = 3600.0
PAIR_BLOCK = 512
NEIGHBOUR_WIDTH_M = 1000.0

TRIP = ["vehicle_id", "trip_no"]


def encode_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    angle = day_angle(F.col(ts))
    return (
        df.withColumn("hour_sin", F.sin(angle)).withColumn("hour_cos", F.cos(angle)).withColumn("dow", monday_weekday(F.col(ts)))
    )


def segment_index(dist: Column, size: float = SEGMENT_M) -> Column:
    return F.floor(dist / F.lit(size)).cast("int")


def renumber(points: DataFrame, bucket_s: int = HOUR_S, tie: str = "event_id") -> DataFrame:
    """Dense ``pos`` of the points left in each trip, ``n_pos`` their count and ``start_ts`` the first time.

    Numbered per (trip, hour); one summary row per (trip, hour) chains the hours.
    """
    keyed = points.withColumn("_b", bucket(F.col("ts"), bucket_s))
    local = Window.partitionBy(*TRIP, "_b").orderBy("ts", tie)
    hours = keyed.groupBy(*TRIP, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_t0"))
    by_trip = Window.partitionBy(*TRIP).orderBy("_b")
    whole = by_trip.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hours = hours.select(
        *TRIP,
        "_b",
        F.coalesce(F.sum("_n").over(by_trip.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias("n_pos"),
        F.min("_t0").over(whole).alias("start_ts"),
    )
    return (
        keyed.withColumn("_row", F.row_number().over(local))
        .join(hours, [*TRIP, "_b"])
        .withColumn("pos", (F.col("_base") + F.col("_row") - 1).cast("long"))
        .drop("_base", "_row", "_b")
    )


def point_scalars(points: DataFrame) -> DataFrame:
    """dist_along_norm, ts_age_s, time_since_start (from the first point kept) and seg_idx; needs start_ts."""
    length = F.when(F.col("length_m") > 0, F.col("length_m")).otherwise(1.0)
    return points.withColumns(
        {
            "dist_along_norm": F.col("along_m") / length,
            "ts_age_s": F.least(F.col("frame_ts") - F.col("ts"), F.lit(MAX_AGE_S)).cast("double"),
            "time_since_start": (F.col("ts") - F.col("start_ts")).cast("double"),
            "seg_idx": segment_index(F.col("along_m")),
        }
    )


def trajectory(points: DataFrame, k: int = HISTORY, block: int = PAIR_BLOCK) -> DataFrame:
    """Last k points up to and including each one: traj_flat of 3k numbers, zero padded at the end.

    Needs pos and dist_along_norm. A block borrows the k-1 points before it.
    """
    own = points.withColumn("_block", bucket(F.col("pos"), block)).withColumn("_own", F.lit(True))
    light = own.select(*TRIP, "_block", "pos", "dist_along_norm", "speed", "ts", F.lit(False).alias("_own"))
    borrowed = light.where(F.col("pos") % block >= block - (k - 1)).withColumn("_block", F.col("_block") + 1)
    rows = own.unionByName(borrowed, allowMissingColumns=True)
    recent = Window.partitionBy(*TRIP, "_block").orderBy("pos").rowsBetween(-(k - 1), 0)
    step = F.struct(
        F.col("dist_along_norm").alias("d"), F.col("speed").cast("double").alias("v"), F.col("ts").cast("double").alias("ts")
    )
    rows = rows.withColumn("_hist", F.collect_list(step).over(recent)).where("_own").drop("_own", "_block")
    cells = F.flatten(
        F.transform(
            "_hist",
            lambda h, i: F.array(
                h["d"], h["v"], F.when(i == 0, F.lit(0.0)).otherwise(h["ts"] - F.get("_hist", F.greatest(i - 1, F.lit(0)))["ts"])
            ),
        )
    )
    return (
        rows.withColumn("traj_flat", F.slice(F.concat(cells, F.array_repeat(F.lit(0.0), 3 * k)), 1, 3 * k))
        .withColumn("traj_len", F.size("_hist"))
        .drop("_hist")
    )


def fleet_table(obs: DataFrame, cap: int = FLEET_CAP) -> DataFrame:
    """The first cap+1 vehicles (by id) of each (line, frame) as an ordered list.

    One vehicle more than the cap, because a point leaves itself out. The rank
    limit is applied before the shuffle, so a crowded frame sends few rows.
    """
    first = Window.partitionBy("line", "frame_ts").orderBy("vehicle_id", "ts")
    rows = obs.where("line is not null").select("line", "frame_ts", "vehicle_id", "ts", "lat", "lon", "speed", "direction_id")
    one_each = rows.groupBy("line", "frame_ts", "vehicle_id").agg(
        F.max_by(F.struct("ts", "lat", "lon", "speed", "direction_id"), F.struct("ts", "lat", "lon")).alias("x")
    ).select("line", "frame_ts", "vehicle_id", "x.*")
    ranked = one_each.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= cap + 1)
    car = F.struct("vehicle_id", "lat", "lon", "speed", "direction_id")
    return ranked.groupBy("line", "frame_ts").agg(F.array_sort(F.collect_list(car)).alias("cars"))


def fleet_context(points: DataFrame, fleet: DataFrame, cap: int = FLEET_CAP, match: str = "frame") -> DataFrame:
    """fleet_flat (5 numbers per other vehicle of the line, zero padded) and n_fleet.

    ``match``: "frame" looks up the point's capture frame, "exact" the frame
    whose time equals the point's own timestamp.
    """
    at = "ts" if match == "exact" else "frame_ts"
    table = fleet.select("line", F.col("frame_ts").alias(at), "cars")
    joined = points.join(table, ["line", at], "left")
    others = F.slice(F.filter(F.coalesce("cars", F.array().cast(fleet.schema["cars"].dataType)), lambda c: c["vehicle_id"] != F.col("vehicle_id")), 1, cap)
    joined = joined.withColumn("_cars", others)
    cells = F.flatten(
        F.transform(
            "_cars",
            lambda c: F.array(
                (c["lat"] - FLEET_CENTRE[0]) * 10.0,
                (c["lon"] - FLEET_CENTRE[1]) * 10.0,
                c["speed"].cast("double"),
                c["direction_id"].cast("double"),
                F.when(c["direction_id"] == F.col("trip_direction_id"), 1.0).otherwise(0.0),
            ),
        )
    )
    width = FLEET_WIDTH * cap
    return (
        joined.withColumn("fleet_flat", F.slice(F.concat(cells, F.array_repeat(F.lit(0.0), width)), 1, width))
        .withColumn("n_fleet", F.size("_cars"))
        .drop("_cars", "cars")
    )


def eligible_trips(points: DataFrame, limit_m: float = 150.0, bucket_s: int = 24 * HOUR_S) -> DataFrame:
    """Trips usable as "previous bus", numbered per branch by start: seq, vehicle, first passage.

    Needs points of mapped shapes. A trip counts with at least two points
    strictly inside the limit.
    """
    per_trip = (
        points.where(F.col("mapped") & (F.col("offset_m") < limit_m))
        .groupBy("shape_id", *TRIP, "trip_start_ts")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("ts").alias("first_ts"))
        .where("_n >= 2")
        .withColumn("_b", bucket(F.col("trip_start_ts"), bucket_s))
    )
    return number_rows(per_trip, ["shape_id"], "_b", ["trip_start_ts", *TRIP], "seq").drop("_b", "_n")


def passage_history(points: DataFrame, trips: DataFrame, keep: int = KEEP_TRIPS, bucket_s: int = 24 * HOUR_S) -> DataFrame:
    """Per trip the (at most ``keep``) eligible trips of its branch started before it, latest first."""
    every = points.where("mapped").groupBy("shape_id", *TRIP, "trip_start_ts").agg(F.count(F.lit(1)).alias("_n"))
    marked = every.join(trips.select("shape_id", *TRIP, F.lit(1).alias("_e")), ["shape_id", *TRIP], "left").withColumn(
        "_e", F.coalesce("_e", F.lit(0))
    )
    placed = running_total(
        marked.withColumn("_b", bucket(F.col("trip_start_ts"), bucket_s)), ["shape_id"], "_b", ["trip_start_ts", *TRIP], "_e", "_upto"
    ).withColumn("_before", F.col("_upto") - F.col("_e"))
    wanted = placed.where("_before > 0").select(
        "shape_id",
        *TRIP,
        F.explode(F.sequence(F.col("_before") - 1, F.greatest(F.col("_before") - keep, F.lit(0)), F.lit(-1).cast("long"))).alias("seq"),
    )
    earlier = trips.select(
        "shape_id", "seq", F.col("vehicle_id").alias("prev_vehicle"), F.col("trip_no").alias("prev_trip_no"), "first_ts"
    )
    entry = F.struct((-F.col("seq")).alias("neg_seq"), "seq", "prev_vehicle", "prev_trip_no", "first_ts")
    return (
        wanted.join(earlier, ["shape_id", "seq"])
        .groupBy("shape_id", *TRIP)
        .agg(F.array_sort(F.collect_list(entry)).alias("history"))
    )


def previous_trip(points: DataFrame, history: DataFrame) -> DataFrame:
    """Add prev: the latest earlier trip of another vehicle already under way at the point's time."""
    joined = points.join(history, ["shape_id", *TRIP], "left")
    usable = F.filter("history", lambda h: (h["prev_vehicle"] != F.col("vehicle_id")) & (h["first_ts"] < F.col("ts")))
    return joined.withColumn("prev", F.get(usable, F.lit(0))).drop("history")


def passage_neighbours(points: DataFrame, limit_m: float = 150.0) -> DataFrame:
    """Map previous-trip seq → pings of that trip around the point's distance.

    Needs ``prev`` on the points. Every point of a trip is looked up in each
    previous trip its trip refers to (at most the history length).
    """
    refs = (
        points.where("prev is not null")
        .groupBy("shape_id", *TRIP, F.col("prev.seq").alias("seq"))
        .agg(F.first("prev.prev_vehicle").alias("pv"), F.first("prev.prev_trip_no").alias("pt"))
    )
    queries = points.select("shape_id", *TRIP, "pos", "along_m").join(refs, ["shape_id", *TRIP]).select(
        F.col("pv").alias("tv"), F.col("pt").alias("tt"), "along_m", *TRIP, "pos", "seq"
    )
    tracks = points.where(F.col("offset_m") < limit_m).select(
        F.col("vehicle_id").alias("tv"), F.col("trip_no").alias("tt"), "along_m", "ts"
    )
    found = bracketing_neighbours(queries, tracks, ["tv", "tt"], "along_m", "ts", NEIGHBOUR_WIDTH_M)
    return found.groupBy(*TRIP, "pos").agg(
        F.map_from_entries(F.collect_list(F.struct("seq", F.struct("below", "above").alias("n")))).alias("passages")
    )


def passage_age(below: Column, above: Column, dist: Column, ts: Column) -> Column:
    """Seconds since the previous bus passed ``dist``, seen from time ``ts``; null where no ping tells.

    Between two pings the time is interpolated; otherwise the nearer-indexed
    ping within 250 m counts, the one below first.
    """
    span = above["at"] - below["at"]
    at = below["tie"] + (dist - below["at"]) / F.when(span > 0, span).otherwise(1.0) * (above["tie"] - below["tie"])
    bracketed = below.isNotNull() & above.isNotNull() & (span > 0) & (at < ts)
    usable = lambda p: p.isNotNull() & (F.abs(p["at"] - dist) <= NEAR_PING_M) & (p["tie"] < ts)
    return F.when(bracketed, ts - at).when(usable(below), (ts - below["tie"]).cast("double")).when(usable(above), (ts - above["tie"]).cast("double"))


def capped_passage(age: Column) -> Column:
    """struct(seconds, found) of a passage's age: capped, and the cap where there is none."""
    return F.struct(F.least(F.coalesce(age, F.lit(PASSAGE_CAP_S)), F.lit(PASSAGE_CAP_S)).alias("seconds"), age.isNotNull().alias("found"))


def interp_passage(below: Column, above: Column, dist: Column, ts: Column) -> Column:
    """struct(seconds, found) since the previous bus passed ``dist``, in one expression."""
    return capped_passage(passage_age(below, above, dist, ts))


def future_pairs(points: DataFrame, p_cols: list[str], f_cols: list[str], min_m: float = MIN_AHEAD_M, block: int = PAIR_BLOCK) -> DataFrame:
    """Each point P with every later point F of its trip at least ``min_m`` ahead and later in time.

    P columns keep their names, F columns get the prefix ``f_``. Points are cut
    in blocks of ``block`` and the self-join runs per (P block, F block), so no
    task sees more than block² pairs of a trip however long the trip is.
    """
    need = ["pos", "along_m", "ts"]
    base = points.withColumn("_own", bucket(F.col("pos"), block)).withColumn("_last", bucket(F.col("n_pos") - 1, block))
    p = base.select(
        *TRIP, F.col("_own").alias("_pb"), F.explode(F.sequence("_own", "_last")).alias("_fb"),
        *[F.col(c) for c in dict.fromkeys(need + p_cols) if c not in TRIP],
    )
    f = base.select(
        *TRIP, F.explode(F.sequence(F.lit(0).cast("long"), "_own")).alias("_pb"), F.col("_own").alias("_fb"),
        *[F.col(c).alias(f"f_{c}") for c in dict.fromkeys(need + f_cols)],
    )
    ahead = F.col("f_along_m") - F.col("along_m")
    return (
        p.join(f, [*TRIP, "_pb", "_fb"])
        .where((F.col("f_pos") > F.col("pos")) & (ahead >= min_m) & (F.col("f_ts") > F.col("ts")))
        .withColumn("dist_remaining_m", ahead)
        .withColumn("observed_eta_s", (F.col("f_ts") - F.col("ts")).cast("double"))
        .drop("_pb", "_fb")
    )


def point_features(
    projected: DataFrame,
    fleet_obs: DataFrame | None = None,
    match: str = "frame",
    mapped_only: bool = True,
    arrays: bool = True,
    store: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """All per-point features of trips on a mapped shape.

    The point table is read three times when the passages of earlier buses are
    looked up; ``store`` writes it out once (a table on shared storage) instead
    of deriving it again.
    """
    keep = store or (lambda df, _name: df)
    src = projected.where("mapped") if mapped_only else projected
    pts = encode_time(point_scalars(renumber(src)))
    pts = keep(previous_trip(pts, passage_history(src, eligible_trips(src))), "points")
    with_passages = pts.join(passage_neighbours(pts), [*TRIP, "pos"], "left")
    if arrays:
        with_passages = trajectory(with_passages)
        if fleet_obs is not None:
            with_passages = fleet_context(with_passages, fleet_table(fleet_obs), match=match)
    return with_passages


SCALARS = [
    "shape_id", "seg_idx", "dist_along_norm", "speed", "hour_sin", "hour_cos", "dow", "time_since_start", "ts_age_s", "day", "line", "prev",
]


def eta_rows(features: DataFrame, arrays: bool = True) -> DataFrame:
    """The ETA table: one row per (P, F) pair with the training columns, plus line, day and keys."""
    own = [*SCALARS, *([c for c in ("traj_flat", "traj_len", "fleet_flat", "n_fleet") if c in features.columns] if arrays else [])]
    pairs = future_pairs(features, own, ["passages"])
    # looked up once and in steps: written as one expression, the generated method is too long for the JVM to compile
    pairs = pairs.withColumn("_around", F.try_element_at("f_passages", F.col("prev.seq"))).drop("f_passages")
    pairs = pairs.withColumns({"_below": F.col("_around.below"), "_above": F.col("_around.above")})
    age = passage_age(F.col("_below"), F.col("_above"), F.col("f_along_m"), F.col("ts"))
    pairs = pairs.withColumn("_age", F.when(F.col("prev").isNotNull() & F.col("_around").isNotNull(), age))
    out = pairs.withColumn("_since", capped_passage(F.col("_age")))
    return out.select(
        F.col("shape_id").alias("ramal_id"),
        "seg_idx",
        "dist_remaining_m",
        "dist_along_norm",
        F.col("speed").alias("speed_mps"),
        "hour_sin",
        "hour_cos",
        "dow",
        F.lit(True).alias("has_active_bus"),
        "observed_eta_s",
        "time_since_start",
        "ts_age_s",
        *[F.col(c) for c in ("traj_flat", "traj_len", "fleet_flat", "n_fleet") if c in own],
        F.col("_since.seconds").alias("time_since_last_bus_s"),
        F.col("_since.found").alias("last_bus_found"),
        "line",
        "day",
        *TRIP,
        F.col("pos").alias("p_pos"),
        "f_pos",
    )


def schedule_medians(train: DataFrame) -> DataFrame:
    """Exact median of elapsed trip time per (branch, twentieth of the path) over distinct observations."""
    seen = train.select(
        "ramal_id", F.col("dist_along_norm").cast("float").alias("d"), F.col("time_since_start").cast("float").alias("tss")
    ).distinct()
    b = seen.where("ramal_id is not null").withColumn("bucket", F.round(F.col("d").cast("double") * 20).cast("int"))
    counts = b.groupBy("ramal_id", "bucket").agg(F.count(F.lit(1)).alias("n_obs"))
    med = exact_quantiles(b, ["ramal_id", "bucket"], "tss", {"expected_time_s": 0.5}, width=10.0)
    return counts.join(med, ["ramal_id", "bucket"])


def monotonicity_audit(medians: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per branch: buckets whose median falls below 95 % of the one before."""
    w = Window.partitionBy("ramal_id").orderBy("bucket")
    prev = F.lag("expected_time_s").over(w)
    flagged = medians.withColumn("_bad", F.when(F.col("expected_time_s") < prev * 0.95, 1).otherwise(0))
    out = flagged.groupBy("ramal_id").agg(F.count(F.lit(1)).alias("n_buckets"), F.sum("_bad").alias("n_violations"))
    limit = F.greatest(F.lit(1), F.floor(F.col("n_buckets") * tolerance))
    return out.withColumn("warn", F.col("n_violations") > limit)


def schedule_deviation(train: DataFrame, medians: DataFrame) -> DataFrame:
    """schedule_dev_norm: clipped lag behind the branch median, 0 where unknown."""
    m = medians.where("bucket between 0 and 20").select("ramal_id", F.col("bucket").alias("_bucket"), "expected_time_s")
    near = F.bround(F.col("dist_along_norm").cast("float").cast("double") * 20).cast("int")
    dev = clip((F.col("time_since_start") - F.col("expected_time_s")) / 600.0, -3.0, 3.0)
    return (
        train.withColumn("_bucket", F.least(F.greatest(near, F.lit(0)), F.lit(20)))
        .join(small(m), ["ramal_id", "_bucket"], "left")
        .withColumn("schedule_dev_norm", F.coalesce(dev, F.lit(0.0)))
        .drop("_bucket", "expected_time_s")
    )


def normalize_scalars(train: DataFrame, max_eta_s: float = 7200.0) -> DataFrame:
    return train.select(
        *[c for c in train.columns if c not in ("observed_eta_s", "time_since_start", "ts_age_s", "time_since_last_bus_s", "has_active_bus", "last_bus_found")],
        clip(F.col("observed_eta_s"), 1.0, max_eta_s).alias("eta_seconds"),
        (F.col("time_since_start") / 3600.0).alias("time_since_start"),
        (F.col("ts_age_s") / 600.0).alias("ts_age_s"),
        (F.log1p("time_since_last_bus_s") / F.log1p(F.lit(3600.0))).alias("time_since_last_bus_s"),
        F.col("has_active_bus").cast("double").alias("has_active_bus"),
        F.col("last_bus_found").cast("double").alias("last_bus_found"),
    )


def normalize_traj(train: DataFrame) -> DataFrame:
    """Distances to [0, 1], speed / 30, clipped Δt / 30; anything not finite becomes 0."""
    cell = lambda x, i: finite_or_zero(
        F.when(i % 3 == 0, clip(x, 0.0, 1.0)).when(i % 3 == 1, x / 30.0).otherwise(clip(x / 30.0, 0.0, 5.0))
    )
    return train.withColumn("traj_norm", F.transform("traj_flat", cell))


def cap_fleet(train: DataFrame, cap: int) -> DataFrame:
    """Vehicles of the same direction first, the first ``cap`` kept, n_fleet recounted."""
    n = F.size("fleet_flat") / FLEET_WIDTH
    cars = F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int")),
        lambda i: F.struct(
            (-F.get("fleet_flat", i * FLEET_WIDTH + 4)).alias("other"), i.alias("i"), F.slice("fleet_flat", i * FLEET_WIDTH + 1, FLEET_WIDTH).alias("x")
        ),
    )
    kept = F.slice(F.array_sort(cars), 1, cap)
    return (
        train.withColumn("_kept", kept)
        .withColumn("fleet_flat", F.transform(F.flatten(F.transform("_kept", lambda c: c["x"])), lambda x: finite_or_zero(x)))
        .withColumn("n_fleet", F.size(F.filter("_kept", lambda c: c["other"] == -1.0)))
        .drop("_kept")
    )


def masks(train: DataFrame, steps: int = HISTORY) -> DataFrame:
    """True marks padding."""
    width = (F.size("fleet_flat") / FLEET_WIDTH).cast("int")
    return train.withColumn("traj_mask", F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i >= F.col("traj_len"))).withColumn(
        "fleet_mask", F.transform(F.sequence(F.lit(0), width - 1), lambda i: i >= F.col("n_fleet"))
    )


def dist_remaining_norm(train: DataFrame, lengths: DataFrame) -> DataFrame:
    l = lengths.select(F.col("length_key").alias("ramal_id"), F.col("length_m").alias("_len"))
    return (
        train.join(small(l), "ramal_id", "left")
        .withColumn("dist_remaining_norm", F.col("dist_remaining_m") / F.greatest(F.coalesce("_len", F.lit(1.0)), F.lit(1.0)))
        .drop("_len")
    )


def _named(name: str):
    return lambda s: F.struct(F.lit(name).alias("name"), s["x"].alias("x"))


def profile(
    train: DataFrame,
    cols: list[str],
    arrays: dict[str, tuple[str, int, int]] | None = None,
    p: float = 0.99,
    width: float = 0.01,
    ranges: dict[str, tuple[float, float]] | None = None,
    scales: dict[str, float] | None = None,
) -> DataFrame:
    """Per column or array component: count, NaN, infinite, min, max, mean and p99 of finite values.

    ``arrays``: name → (array column, stride, component). Also the finite values (``n_valid``), those of them outside
    ``ranges``: name → (low, high), bounds included (``n_outside``, 0 without a range), and the greatest magnitude
    after division by ``scales``: name → divisor (``max_abs``). Nulls count in ``n`` alone.
    """
    parts = [F.array(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x"))) for c in cols]
    for name, (col, stride, k) in (arrays or {}).items():
        picked = F.filter(F.transform(col, lambda x, i: F.struct(x.cast("double").alias("x"), (i % stride == k).alias("on"))), lambda s: s["on"])
        parts.append(F.transform(picked, _named(name)))
    long = train.select(F.explode(F.concat(*parts)).alias("e")).select("e.*")
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    ok = F.when(~bad, F.col("x"))
    outside = F.lit(False)
    for name, (low, high) in (ranges or {}).items():
        outside = outside | ((F.col("name") == name) & ~bad & ~F.col("x").between(low, high))
    divisor = F.lit(1.0)
    for name, by in (scales or {}).items():
        divisor = F.when(F.col("name") == name, F.lit(float(by))).otherwise(divisor)
    stats = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.isnan("x"), 1).otherwise(0)).alias("n_nan"),
        F.sum(F.when(F.abs("x") == float("inf"), 1).otherwise(0)).alias("n_inf"),
        F.count(ok).alias("n_valid"),
        F.count_if(outside).alias("n_outside"),
        F.min(ok).alias("min"),
        F.max(ok).alias("max"),
        F.avg(ok).alias("mean"),
        F.max(F.abs(ok) / divisor).alias("max_abs"),
    )
    # a column is one group, as large as the table
    return stats.join(exact_quantiles(long.where(~bad), ["name"], "x", {"p99": p}, width=width, narrow=True), "name", "left")


def sample_pairs(rows: DataFrame, m: int = 8, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """At most m rows per trip, chosen by a stable hash. The limit is applied before the shuffle."""
    return _sample(rows, TRIP, m, seed, keys or [*TRIP, "p_pos", "f_pos"])


def stratified_sample(rows: DataFrame, n: int = 1000, seed: int = 42, strata: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """n rows per (branch, hour, weekday)."""
    return _sample(rows, strata or ["ramal_id", "hour", "dow"], n, seed, keys or [*TRIP, "p_pos", "f_pos"])


def _sample(rows: DataFrame, by: list[str], n: int, seed: int, keys: list[str]) -> DataFrame:
    keyed = rows.withColumn("_o", stable_order(seed, *[F.col(k) for k in keys]))
    order = Window.partitionBy(*by).orderBy("_o", *keys)
    return keyed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r", "_o")


def shuffle_rows(train: DataFrame, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """Reproducible global shuffle by hash range."""
    keys = keys or [*TRIP, "p_pos", "f_pos"]
    return train.withColumn("shuffle_key", stable_order(seed, *[F.col(k) for k in keys])).orderBy("shuffle_key", *keys)
