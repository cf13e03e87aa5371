"""Cutting vehicle histories into trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.scale import HOUR_S, bucket, number_rows, small, with_previous

GAP_S = 600
MIN_POINTS = 5


def _is_cut(prev: Column, cur: Column, gap_s: int) -> Column:
    changed = ~(
        prev["start_time"].eqNullSafe(cur["start_time"])
        & prev["start_date"].eqNullSafe(cur["start_date"])
        & prev["direction_id"].eqNullSafe(cur["direction_id"])
    )
    return F.when(((cur["ts"] - prev["ts"]) > gap_s) | changed, 1).otherwise(0)


def segment_trips(
    obs: DataFrame, gap_s: int = GAP_S, min_points: int = MIN_POINTS, tie: str = "event_id", bucket_s: int = HOUR_S
) -> DataFrame:
    """Add trip_no, point_no, n_points and the first point's route, direction and time.

    A trip ends on a gap longer than ``gap_s``, or when the start time, start
    date or direction changes. Each (vehicle, hour) is ordered on its own and
    split in pieces; one summary row per piece decides which pieces of adjacent
    hours form one trip, so a vehicle's points are never sorted in one task.
    """
    order = ["ts", tie]
    cur = F.struct("ts", "direction_id", "start_date", "start_time")
    local = Window.partitionBy("vehicle_id", "_b").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        obs.withColumn("_b", bucket(F.col("ts"), bucket_s))
        .withColumn("_p", F.lag(cur).over(local))
        .withColumn("_cut", F.when(F.col("_p").isNull(), 0).otherwise(_is_cut(F.col("_p"), cur, gap_s)))
        .withColumns(
            {
                "_piece": F.sum("_cut").over(running),
                "_row": F.row_number().over(local),
                "_first": (F.col("_cut") == 1) | (F.row_number().over(local) == 1),
                "_final": F.coalesce(F.lead("_cut").over(local), F.lit(1)) == 1,
            }
        )
        .drop("_p", "_cut")
    )
    # a piece is told by its first and its last row, which follow each other where no other row is left
    header = F.struct(
        F.col("route_id").alias("trip_route_id"), F.col("direction_id").alias("trip_direction_id"), F.col("ts").alias("trip_start_ts")
    )
    ends = rows.where("_first or _final").select("vehicle_id", "_b", "_piece", "_row", "_first", "_final", cur.alias("_head"), header.alias("_header"))
    rows = rows.drop("_first", "_final")
    by_row = Window.partitionBy("vehicle_id").orderBy("_b", "_row")
    ends = ends.withColumns({"_last": F.lag("_head").over(by_row), "_next": F.lead("_row").over(by_row)}).where("_first")
    pieces = ends.withColumn("_n", (F.when(F.col("_final"), F.col("_row")).otherwise(F.col("_next")) - F.col("_row") + 1).cast("long"))
    pieces = pieces.withColumnRenamed("_row", "_first_row").drop("_first", "_final", "_next")
    by_vehicle = Window.partitionBy("vehicle_id").orderBy("_b", "_piece")
    by_trip = Window.partitionBy("vehicle_id", "trip_no").orderBy("_b", "_piece")
    whole = by_trip.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_trip.rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("_last")
    pieces = (
        pieces.withColumn("_new", F.when(last.isNull(), 0).when(F.col("_piece") > 0, 1).otherwise(_is_cut(last, F.col("_head"), gap_s)))
        .withColumn("trip_no", F.sum("_new").over(by_vehicle).cast("long"))
        .withColumns(
            {
                "n_points": F.sum("_n").over(whole),
                "_start": F.first("_header").over(whole),
                "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first_row"),
            }
        )
        .where(F.col("n_points") >= min_points)
        .select("vehicle_id", "_b", F.col("_piece").alias("_own"), "trip_no", "n_points", "_offset", "_start.*")
    )
    # joined on the partitioning the rows already have; the piece is matched as a residual condition
    return (
        rows.join(pieces, ["vehicle_id", "_b"])
        .where("_own - _piece = 0")
        .withColumn("point_no", (F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_offset", "_own", "_piece", "_row", "_b")
    )


def trip_headers(points: DataFrame) -> DataFrame:
    return points.where("point_no = 0").select(
        "vehicle_id", "trip_no", "trip_route_id", "trip_direction_id", "trip_start_ts", "n_points"
    )


def trips_by_route(points: DataFrame, line_of_route: DataFrame) -> DataFrame:
    """Trip headers with the line looked up by route id (validation path)."""
    routes = line_of_route.select(F.col("route_id").alias("trip_route_id"), F.col("line").alias("route_line"))
    return trip_headers(points).join(small(routes), "trip_route_id", "left")


def trip_summary(projected: DataFrame) -> DataFrame:
    """One row per trip that kept at least one point near its shape."""
    return projected.groupBy(
        "vehicle_id", "trip_no", "trip_route_id", "trip_direction_id", "trip_start_ts", "line"
    ).agg(F.count(F.lit(1)).alias("n_points"))


def trip_sequence(obs: DataFrame, trip_key: str = "trip_id", tie: str = "event_id", bucket_s: int = HOUR_S) -> DataFrame:
    """1-based position and seconds since the previous ping inside (vehicle, trip id)."""
    keyed = obs.withColumn("_b", bucket(F.col("ts"), bucket_s))
    keys = ["vehicle_id", trip_key]
    numbered = number_rows(keyed, keys, "_b", ["ts", tie], "seq_in_trip")
    return (
        with_previous(numbered, keys, "_b", ["ts", tie], ["ts"], "_prev")
        .withColumn("seq_in_trip", F.col("seq_in_trip") + 1)
        .withColumn("delta_s", F.col("ts") - F.col("_prev.ts"))
        .drop("_prev", "_b")
    )
