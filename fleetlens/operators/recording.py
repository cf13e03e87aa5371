"""Health figures of the recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas

FULL_DAY_BYTES = 50_000_000
MONTH_DAYS, YEAR_DAYS = 30, 365


def quick_counts(lines: DataFrame) -> DataFrame:
    """Line kinds per day by substring, without parsing."""
    text = F.col("text")
    is_gap = text.contains('"gap": true') | text.contains('"gap":true')
    is_key = text.contains('"keyframe": true') | text.contains('"keyframe":true')
    kind = F.when(is_gap, "gap").when(is_key, "keyframe").when(F.trim(text) != "", "delta")
    count = lambda k: F.sum(F.when(kind == k, 1).otherwise(0))
    return (
        lines.groupBy("day")
        .agg(count("keyframe").alias("keyframes"), count("delta").alias("deltas"), count("gap").alias("gaps"))
        .withColumn("total_cycles", F.col("keyframes") + F.col("deltas"))
    )


def file_stats(lines: DataFrame, order: list[str]) -> DataFrame:
    """Full statistics per day: kinds, bytes, first and last time, mean vehicles and updates (truncated)."""
    f = lines.withColumn("f", F.from_json("text", schemas.FRAME)).where("f.t is not null")
    gap, key = F.coalesce("f.gap", F.lit(False)), F.coalesce("f.keyframe", F.lit(False))
    kind = F.when(gap, "gap").when(key, "keyframe").otherwise("delta")
    size = F.length("text") + 1
    n_new, n_upd = F.coalesce(F.size("f.new"), F.lit(0)), F.coalesce(F.size("f.upd"), F.lit(0))
    n_new, n_upd = F.greatest(n_new, F.lit(0)), F.greatest(n_upd, F.lit(0))
    total = lambda k, what: F.coalesce(F.sum(F.when(kind == k, what)), F.lit(0))
    mean = lambda k, what: F.coalesce(F.floor(F.avg(F.when(kind == k, what))), F.lit(0))
    s = f.groupBy("day").agg(
        total("keyframe", F.lit(1)).alias("keyframes"),
        total("delta", F.lit(1)).alias("deltas"),
        total("gap", F.lit(1)).alias("gaps"),
        total("keyframe", size).alias("kf_bytes"),
        total("delta", size).alias("delta_bytes"),
        mean("keyframe", n_new).alias("avg_kf_veh"),
        mean("delta", n_new + n_upd).alias("avg_delta_upd"),
        F.min_by("f.t", F.struct(*order)).alias("first_ts"),
        F.max_by("f.t", F.struct(*order)).alias("last_ts"),
    )
    both = (F.col("first_ts") != 0) & (F.col("last_ts") != 0)
    return s.withColumn("total_cycles", F.col("keyframes") + F.col("deltas")).withColumn(
        "duration_s", F.when(both, F.col("last_ts") - F.col("first_ts")).otherwise(0)
    )


def file_sizes(lines: DataFrame) -> DataFrame:
    """Stored bytes per day; a day may span several files."""
    return lines.groupBy("day", "file").agg(F.max("file_bytes").alias("b")).groupBy("day").agg(F.sum("b").alias("bytes"))


def storage_summary(files: DataFrame, full_day: int = FULL_DAY_BYTES) -> DataFrame:
    """Totals, mean of full days with month and year projections, smallest and largest day."""
    full = F.when(F.col("bytes") > full_day, F.col("bytes"))
    s = files.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("bytes").alias("total_bytes"),
        F.count(full).alias("n_full_days"),
        F.coalesce(F.avg(full), F.lit(0.0)).alias("avg_bytes"),
        F.min_by("day", F.struct("bytes", "day")).alias("min_day"),
        F.min("bytes").alias("min_bytes"),
        F.min_by("day", F.struct(-F.col("bytes"), "day")).alias("max_day"),
        F.max("bytes").alias("max_bytes"),
    )
    return s.withColumn("month_bytes", F.col("avg_bytes") * MONTH_DAYS).withColumn("year_bytes", F.col("avg_bytes") * YEAR_DAYS)


def day_progress(stats: DataFrame, files: DataFrame) -> DataFrame:
    """Share of the day recorded, compression ratio and projected size; for the current day, or any."""
    j = stats.join(files, "day")
    done = F.col("duration_s") / 86400 * 100
    return j.select(
        "day",
        done.alias("pct_done"),
        F.when(F.col("bytes") > 0, (F.col("kf_bytes") + F.col("delta_bytes")) / F.col("bytes")).otherwise(0.0).alias("ratio"),
        F.when(done > 0, F.col("bytes") / (F.when(done > 0, done) / 100)).alias("projected_bytes"),
    )


def daily_breakdown(counts: DataFrame, files: DataFrame) -> DataFrame:
    return counts.join(files, "day", "full_outer").select(
        "day", "bytes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_cycles", "keyframes", "deltas", "gaps")]
    ).orderBy("day")
