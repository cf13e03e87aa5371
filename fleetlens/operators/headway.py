"""Ping gaps, passages and headways along branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.calendar import LOCAL_ZONE, local_hour
from fleetlens.functions.values import share
from fleetlens.operators.geometry import best_branch_per_trip, project_near
from fleetlens.operators.scale import HOUR_S, bracketing_neighbours, bucket, exact_quantiles, with_previous

# fixed values
CHECKPOINT_M = 500.0
NEAR_M = 250.0
MAX_HEADWAY_S = 7200
PEAK_HOURS = [7, 8, 17, 18]
TRIP = ["vehicle_id", "trip_no"]


def headway_points(points: DataFrame, paths: DataFrame, limit_m: float = 150.0) -> DataFrame:
    """Points of each trip on its best branch, strictly inside the limit."""
    chosen = best_branch_per_trip(points, paths, limit_m).select(*TRIP, "shape_id")
    on = project_near(points.join(chosen, TRIP), paths, ["shape_id"], ["length_m"], limit_m)
    return on.where(F.col("offset_m") < limit_m).select(*TRIP, "shape_id", "length_m", "event_id", "ts", "along_m")


def trip_spans(points: DataFrame) -> DataFrame:
    """Trips and the median, P10 and P90 of the covered distance."""
    spans = points.groupBy(*TRIP).agg((F.max("along_m") - F.min("along_m")).alias("span_m"))
    n = spans.agg(F.count(F.lit(1)).alias("n_trips")).withColumn("_k", F.lit(0))
    q = exact_quantiles(spans, [], "span_m", {"p50_m": 0.5, "p10_m": 0.1, "p90_m": 0.9}, width=10.0, narrow=True)
    return n.join(q.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")


def consecutive(points: DataFrame) -> DataFrame:
    """Each point with the one before it in its trip: prev.ts, prev.along_m."""
    keyed = points.withColumn("_b", bucket(F.col("ts"), HOUR_S))
    return with_previous(keyed, TRIP, "_b", ["ts", "event_id"], ["ts", "along_m"], "prev")


def ping_gaps(points: DataFrame) -> DataFrame:
    """Distribution of the seconds between consecutive points, gaps of an hour or more left out."""
    gaps = consecutive(points).select((F.col("ts") - F.col("prev.ts")).alias("dt")).where("dt > 0 and dt < 3600")
    stats = gaps.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dt").alias("mean_s"),
        F.max("dt").alias("max_s"),
        *[share(F.col("dt") > s).alias(f"share_over_{s}s") for s in (60, 120, 300)],
    ).withColumn("_k", F.lit(0))
    q = exact_quantiles(gaps, [], "dt", {f"p{p}_s": p / 100 for p in (25, 50, 75, 90, 95, 99)}, width=10.0)
    return stats.join(q.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")


def target_grid(points: DataFrame, step_m: float = NEAR_M, margin_m: float = 100.0) -> DataFrame:
    """Targets every ``step_m`` inside each trip's covered range; at most length / step per trip."""
    spans = points.groupBy(*TRIP).agg(F.min("along_m").alias("_lo"), F.max("along_m").alias("_hi"))
    first = F.ceil((F.col("_lo") + margin_m) / step_m).cast("int")
    last = F.floor((F.col("_hi") - margin_m) / step_m).cast("int")
    return (
        spans.where(first <= last)
        .select(*TRIP, F.explode(F.sequence(first, last)).alias("target_no"))
        .withColumn("along_m", F.col("target_no") * F.lit(float(step_m)))
    )


def bracket_coverage(points: DataFrame, targets: DataFrame, step_m: float = NEAR_M, near_m: float = NEAR_M) -> DataFrame:
    """How many targets lie between two consecutive points, only near one, or neither."""
    pairs = consecutive(points).where("prev is not null and prev.along_m <= along_m")
    first, last = F.ceil(F.col("prev.along_m") / step_m).cast("int"), F.floor(F.col("along_m") / step_m).cast("int")
    inside = (
        pairs.where(first <= last).select(*TRIP, F.explode(F.sequence(first, last)).alias("target_no")).distinct().withColumn("_in", F.lit(True))
    )
    around = bracketing_neighbours(targets, points.select(*TRIP, "along_m", "ts"), TRIP, "along_m", "ts", 1000.0)
    gap = F.least(F.abs(F.col("along_m") - F.col("below.at")), F.abs(F.col("above.at") - F.col("along_m")))
    state = F.when(F.col("_in"), "bracketed").when(gap <= near_m, "near").otherwise("miss")
    return around.join(inside, [*TRIP, "target_no"], "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def passages(points: DataFrame, step_m: float = CHECKPOINT_M) -> DataFrame:
    """First interpolated passage of every trip at each checkpoint of its branch."""
    pairs = consecutive(points).where("prev is not null and prev.along_m < along_m")
    d0, t0 = F.col("prev.along_m"), F.col("prev.ts")
    first = F.greatest(F.ceil(d0 / step_m), F.lit(1)).cast("int")
    last = F.least(F.floor(F.col("along_m") / step_m), F.ceil(F.col("length_m") / step_m) - 1).cast("int")
    at = pairs.where(first <= last).select(*TRIP, "shape_id", "ts", "event_id", "along_m", d0.alias("d0"), t0.alias("t0"), F.explode(F.sequence(first, last)).alias("checkpoint"))
    ck = F.col("checkpoint") * F.lit(float(step_m))
    at = at.withColumn("passed_at", F.col("t0") + (ck - F.col("d0")) / F.when(F.col("along_m") > F.col("d0"), F.col("along_m") - F.col("d0")) * (F.col("ts") - F.col("t0")))
    return at.groupBy(*TRIP, "shape_id", "checkpoint").agg(F.min_by("passed_at", F.struct("ts", "event_id")).alias("passed_at"))


def headways(passed: DataFrame, points: DataFrame, min_trips: int = 3, max_s: int = MAX_HEADWAY_S) -> DataFrame:
    """Seconds between consecutive passages at a checkpoint, on branches with enough trips."""
    trips = points.select("shape_id", *TRIP).distinct().groupBy("shape_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_trips)
    keyed = passed.join(trips.select("shape_id"), "shape_id", "left_semi").withColumn("_b", bucket(F.col("passed_at"), 4 * HOUR_S))
    linked = with_previous(keyed, ["shape_id", "checkpoint"], "_b", ["passed_at", *TRIP], ["passed_at"], "prev")
    return (
        linked.withColumn("headway_s", F.col("passed_at") - F.col("prev.passed_at"))
        .where((F.col("headway_s") > 0) & (F.col("headway_s") <= max_s))
        .select("shape_id", "checkpoint", F.col("prev.passed_at").alias("from_s"), "headway_s")
    )


def headway_stats(hw: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Distribution over the whole day, the peak hours and the rest."""
    hour = local_hour(F.floor("from_s").cast("long"), zone)
    scoped = hw.select(
        "headway_s", F.explode(F.array(F.lit("all"), F.when(hour.isin(PEAK_HOURS), "peak").otherwise("off_peak"))).alias("scope")
    )
    h = F.col("headway_s")
    stats = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(h).alias("mean_s"),
        F.max(h).alias("max_s"),
        share(h < 180).alias("share_under_3min"),
        share((h >= 180) & (h < 600)).alias("share_3_10min"),
        share(h >= 600).alias("share_over_10min"),
        share(h > 3600).alias("share_over_1h"),
    )
    q = exact_quantiles(scoped, ["scope"], "headway_s", {f"p{p}_s": p / 100 for p in (10, 25, 50, 75, 90, 95)}, width=10.0, narrow=True)
    return stats.join(q, "scope")


def interp_error(points: DataFrame) -> DataFrame:
    """Error of linear interpolation at the middle of three advancing points."""
    keyed = consecutive(points).drop("_b").withColumn("_b", bucket(F.col("ts"), HOUR_S))
    chain = with_previous(keyed, TRIP, "_b", ["ts", "event_id"], ["ts", "along_m", "prev"], "back")
    d0, t0 = F.col("back.prev.along_m"), F.col("back.prev.ts")
    d1, t1 = F.col("back.along_m"), F.col("back.ts")
    d2, t2 = F.col("along_m"), F.col("ts")
    ok = chain.where((d0 < d1) & (d1 < d2) & (t2 > t0))
    # the filter may be evaluated after the quotient, so that one guards itself
    errors = ok.select(F.abs(t0 + (d1 - d0) / F.when(d2 > d0, d2 - d0) * (t2 - t0) - t1).alias("error_s"))
    stats = errors.agg(
        F.count(F.lit(1)).alias("n"), F.avg("error_s").alias("mean_s"), *[share(F.col("error_s") < s).alias(f"share_under_{s}s") for s in (10, 30, 60)]
    ).withColumn("_k", F.lit(0))
    q = exact_quantiles(errors, [], "error_s", {f"p{p}_s": p / 100 for p in (50, 75, 90, 95, 99)}, width=1.0, narrow=True)
    return stats.join(q.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")
