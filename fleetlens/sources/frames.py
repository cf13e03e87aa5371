"""Recordings of the vehicle feed: scan, day selection, normalisation and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators.filters import FEED_BOX, in_box
from fleetlens.operators.scale import running_total, small

# the day of a file is in its own name or in the folder that holds it, never further up
DAY = r"/(?:day=)?(\d{4}-\d{2}-\d{2})(?:\.ndjson(?:\.gz)?|/[^/]*)$"
DAY_FILE = r"(\d{4}-\d{2}-\d{2})\.ndjson(?:\.gz)?$"
LOCAL_OFFSET_S = -3 * 3600


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw text lines of every daily file below ``path`` with day and position.

    Line order is (file, split start, id): a compressed file is one split, and
    the id grows along each split.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    return (
        raw.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("file_bytes"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_id"),
            F.col("value").alias("text"),
        )
        .withColumn("day", F.regexp_extract("file", DAY, 1))
        .where(F.col("day") != "")
    )


def only_daily_files(lines: DataFrame) -> DataFrame:
    """Keep files named YYYY-MM-DD.ndjson(.gz) or written below day=YYYY-MM-DD."""
    return lines.where(F.col("file").rlike(DAY_FILE) | F.col("file").contains("/day="))


def parse_frames(lines: DataFrame) -> DataFrame:
    """Frames of all kinds; blank and broken lines are skipped.

    Adds ``frame_no``: a dense position over all files, counted per file and
    chained through one row per file. Parts of one frame share its number.
    """
    parsed = (
        lines.where(F.trim("text") != "")
        .withColumn("f", F.from_json("text", schemas.FRAME, {"mode": "PERMISSIVE"}))
        .where(F.col("f.t").isNotNull())
    )
    flat = parsed.select("day", "file", "block_start", "line_id", "f.*").withColumn("part", F.coalesce("part", F.lit(0)))
    position = ["block_start", "line_id"]
    starts = flat.select(
        "file", *position, F.struct("day", "file").alias("_file"), F.when(F.col("part") == 0, 1).otherwise(0).alias("_start")
    )
    numbered = running_total(starts, [], "_file", position, "_start", "frame_no").select(
        "file", *position, (F.col("frame_no") - 1).alias("frame_no")
    )
    return flat.join(numbered, ["file", *position]).drop(*position)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return parse_frames(only_daily_files(scan_lines(spark, path)))


def select_days(
    frames: DataFrame, skip_first: int = 0, max_days: int | None = None, exclude: str | None = None, day: str = "day"
) -> DataFrame:
    """Chronological day selection: drop one day, skip the first n, keep the next m."""
    days = frames.select(day).distinct()
    if exclude is not None:
        days = days.where(F.col(day) != exclude)
    # one row per calendar day: a single ordered window is bounded by the calendar
    ranked = days.withColumn("_n", F.row_number().over(Window.orderBy(day)))
    kept = ranked.where(F.col("_n") > skip_first)
    if max_days is not None:
        kept = kept.where(F.col("_n") <= skip_first + max_days)
    return frames.join(small(kept.select(day)), day, "left_semi")


def count_days(frames: DataFrame, day: str = "day") -> DataFrame:
    return frames.select(day).distinct().agg(F.count(F.lit(1)).alias("n_days"))


def require_days(frames: DataFrame, n: int = 90, day: str = "day") -> DataFrame:
    """Raise when fewer than ``n`` days are present; one aggregate row is read."""
    found = count_days(frames, day).first()["n_days"]
    if found < n:
        raise ValueError(f"{found} days of recordings, {n} needed")
    return frames


def normalize_feed(rows: DataFrame) -> DataFrame:
    """Decoded feed rows inside the service area, coordinates at 6 and speed at 2 digits."""
    return in_box(rows, **FEED_BOX).select(
        *[
            F.round(F.col(c), 6 if c in ("lat", "lon") else 2).alias(c) if c in ("lat", "lon", "speed") else F.col(c)
            for c in schemas.VEHICLE_FIELDS
        ]
    )


def normalize_live(rows: DataFrame, now: int, position: str = "pos") -> DataFrame:
    """Alias fallback per field, area filter, last row per vehicle id.

    Empty strings and zeros count as missing, as the feed's clients expect.
    """

    def text(*names: str) -> Column:
        return F.coalesce(*[F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names], F.lit(""))

    def number(kind: str, default, *names: str) -> Column:
        return F.coalesce(*[F.when(F.col(n) != 0, F.col(n).cast(kind)) for n in names], F.lit(default).cast(kind))

    clean = rows.select(
        F.col(position).alias("_pos"),
        text("VP_vehicle_id", "id").alias("vehicle_id"),
        number("double", 0.0, "VP_latitude", "lat").alias("lat"),
        number("double", 0.0, "VP_longitude", "lon").alias("lon"),
        text("VP_route_id", "route_id").alias("route_id"),
        number("int", 0, "VP_direction_id", "direction_id").alias("direction_id"),
        number("double", 0.0, "VPS_speed", "speed").alias("speed"),
        number("long", now, "VP_timestamp", "ts").alias("ts"),
        text("LD_label", "VP_label", "label").alias("label"),
        F.coalesce(F.when(F.col("LD_linea") != "", F.col("LD_linea")), F.col("line_number")).alias("line"),
    ).where(F.col("vehicle_id") != "")
    inside = in_box(clean, **FEED_BOX)
    fields = [c for c in inside.columns if c not in ("_pos", "vehicle_id")]
    return inside.groupBy("vehicle_id").agg(F.max_by(F.struct(*fields), "_pos").alias("v")).select("vehicle_id", "v.*")


def frame_lines(frames: DataFrame) -> DataFrame:
    """Frames as JSON text; absent parts are left out of the line."""
    shape = ["t", "keyframe", "gap", "gap_seconds", "reason", "part", "new", "del", "upd"]
    present = [c for c in shape if c in frames.columns]
    others = [c for c in frames.columns if c not in present]
    return frames.select(*others, F.to_json(F.struct(*present)).alias("value"))


def write_frames(frames: DataFrame, path: str, offset_s: int = LOCAL_OFFSET_S, order: str = "frame_no") -> None:
    """NDJSON+gzip, one folder per local day, frames of a day in order.

    A day is one sorted gzip member: rows are range-partitioned by (day, order)
    and sorted inside, so a large day spans several part files in name order.
    The lines of one frame stay together, in the order of their parts.
    """
    day = F.date_format(F.timestamp_seconds(F.col("t") + F.lit(offset_s)), "yyyy-MM-dd")
    rows = frames.withColumns({"day": day, "_part": F.coalesce("part", F.lit(0)) if "part" in frames.columns else F.lit(0)})
    lines = frame_lines(rows.select("day", order, "_part", *[c for c in frames.columns if c not in ("day", order)]))
    (
        lines.select("day", order, "_part", "value")
        .repartitionByRange("day", order)
        .sortWithinPartitions("day", order, "_part")
        .select("day", "value")
        .write.mode("overwrite")
        .partitionBy("day")
        .option("compression", "gzip")
        .text(path)
    )
