"""Predicates, line resolution and request validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.calendar import PEAK_HOURS_UTC, utc_hour
from fleetlens.functions.values import last_token
from fleetlens.operators.scale import small

# fixed values
FEED_BOX = {"lat_min": -35.1, "lat_max": -34.3, "lon_min": -59.1, "lon_max": -57.9}
REQUEST_BOX = {"lat_min": -35.5, "lat_max": -34.0, "lon_min": -59.5, "lon_max": -57.5}
RADIUS_RANGE_M = (50.0, 2000.0)
RADIUS_DEFAULT_M = 300.0
RESULTS_RANGE = (1, 10)
RESULTS_DEFAULT = 3
MAX_LINE = 200
MIN_REMAINING_M = 100.0


def in_box(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float, lat="lat", lon="lon") -> DataFrame:
    return df.where(F.col(lat).between(lat_min, lat_max) & F.col(lon).between(lon_min, lon_max))


def resolve_line(df: DataFrame, label_map: DataFrame, out: str = "line") -> DataFrame:
    """Line of the label's last token; null where unmapped."""
    m = label_map.select(F.col("suffix").alias("_suffix"), F.col("line").alias(out))
    return df.withColumn("_suffix", last_token(F.col("label"))).join(small(m), "_suffix", "left").drop("_suffix")


def resolve_line_agency(df: DataFrame, label_map: DataFrame, max_line: int = MAX_LINE) -> DataFrame:
    """Line and agency; both null where the line is missing, not numeric or above the cap."""
    m = label_map.where(F.expr("try_cast(line as int)") <= max_line).select(F.col("suffix").alias("_suffix"), "line", "agency")
    return df.withColumn("_suffix", last_token(F.col("label"))).join(small(m), "_suffix", "left").drop("_suffix")


def vehicles_of_line(live: DataFrame, line: str) -> DataFrame:
    return live.where(F.col("line") == line)


def vehicles_of_routes(live: DataFrame, routes: DataFrame) -> DataFrame:
    return live.join(small(routes.select("route_id").distinct()), "route_id", "left_semi")


def peak_frames(frames: DataFrame, hours: list[int] = PEAK_HOURS_UTC, ts: str = "t") -> DataFrame:
    return frames.where(utc_hour(F.col(ts)).isin(hours))


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Inclusive list of days; empty when the end precedes the start."""
    one = spark.range(1).select(F.to_date(F.lit(start)).alias("a"), F.to_date(F.lit(end)).alias("b"))
    return one.where("a <= b").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))


def day_span(days: DataFrame, day: str = "day") -> DataFrame:
    """Every calendar day between the first and the last one present."""
    ends = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))


def valid_rows(train: DataFrame) -> DataFrame:
    return train.where(
        (F.col("observed_eta_s") > 0)
        & (F.col("dist_remaining_m") >= MIN_REMAINING_M)
        & F.col("dist_along_norm").between(0.0, 1.0)
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Fill defaults and add ``reason``: null for a valid request, else the first broken rule."""
    filled = requests.withColumn("radius_m", F.coalesce("radius_m", F.lit(RADIUS_DEFAULT_M))).withColumn(
        "max_results", F.coalesce("max_results", F.lit(RESULTS_DEFAULT))
    )
    box = REQUEST_BOX
    lat_ok = F.coalesce(F.col("lat").between(box["lat_min"], box["lat_max"]), F.lit(False))
    lon_ok = F.coalesce(F.col("lon").between(box["lon_min"], box["lon_max"]), F.lit(False))
    return filled.withColumn(
        "reason",
        F.when(~lat_ok, "lat")
        .when(~lon_ok, "lon")
        .when(F.col("line").isNotNull() & ~F.col("line").rlike(r"^\d{1,4}$"), "line")
        .when(~F.col("radius_m").between(*RADIUS_RANGE_M), "radius_m")
        .when(~F.col("max_results").between(*RESULTS_RANGE), "max_results"),
    )


def valid_requests(checked: DataFrame) -> DataFrame:
    return checked.where("reason is null").drop("reason")


def rejected_requests(checked: DataFrame) -> DataFrame:
    return checked.where("reason is not null")
