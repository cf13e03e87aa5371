"""Life cycles of route ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.scale import small

MIN_NEW = 3
ABSENCE_DAYS = 5
ROUTE = ["line", "route_id"]


def _known(obs: DataFrame) -> DataFrame:
    return obs.where("line is not null and coalesce(trim(route_id), '') <> ''")


def active_days(obs: DataFrame) -> DataFrame:
    """(line, route, day) with its observation count; everything else derives from this small table."""
    return _known(obs).groupBy(*ROUTE, "day").agg(F.count(F.lit(1)).alias("n"), F.collect_set("direction_id").alias("dirs"))


def route_lifecycle(obs: DataFrame) -> DataFrame:
    return active_days(obs).groupBy(*ROUTE).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("dirs")))).alias("direction_ids"),
        F.min("day").alias("first_seen"),
        F.max("day").alias("last_seen"),
        F.count(F.lit(1)).alias("days_active"),
        F.sum("n").alias("obs_count"),
    )


def route_daily(obs: DataFrame) -> DataFrame:
    """Active and newly seen ids per (line, day)."""
    days = active_days(obs).select(*ROUTE, "day")
    first = F.min("day").over(Window.partitionBy(*ROUTE))
    return (
        days.withColumn("_new", F.when(F.col("day") == first, 1).otherwise(0))
        .groupBy("line", "day")
        .agg(F.count(F.lit(1)).alias("n_active"), F.sum("_new").alias("n_new"))
    )


def rotation_events(lifecycle: DataFrame, first_day: DataFrame, min_new: int = MIN_NEW) -> DataFrame:
    """Days on which at least ``min_new`` ids of a line appear, and what became of the older ids.

    ``first_day``: one row with the recording's first day, which never counts.
    Ids are counted per (line, first day) and per (line, last day); running sums over a line's days
    then give how many came before an event, how many had gone by then and how long the others last,
    so no id or span meets an event.
    """
    born = lifecycle.groupBy("line", F.col("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("n_new"), F.max("last_seen").alias("_until"))
    # an id is gone from the day after its last on; only ids born before an event count, and those are all whose last day lies before it
    ended = lifecycle.groupBy("line", F.date_format(F.date_add(F.to_date("last_seen"), 1), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("_ended"))
    start = first_day.select(F.col("day").alias("_start")).withColumn("_k", F.lit(0))
    days = born.join(ended, ["line", "day"], "full").fillna(0, ["n_new", "_ended"])
    upto = Window.partitionBy("line").orderBy("day")  # a row per day with a change
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    swept = days.withColumns(
        {
            "_came": F.coalesce(F.sum("n_new").over(before), F.lit(0)),
            "n_gone": F.sum("_ended").over(upto.rowsBetween(Window.unboundedPreceding, 0)),
            "_longest": F.max("_until").over(before),
        }
    )
    events = swept.where(F.col("n_new") >= min_new).withColumn("_k", F.lit(0)).join(small(start), "_k").where("day <> _start")
    overlap = F.greatest(F.coalesce(F.datediff("_longest", "day"), F.lit(0)), F.lit(0))
    return events.select("line", "day", "n_new", "n_gone", (F.col("_came") - F.col("n_gone")).alias("n_still_active"), overlap.alias("max_overlap_days"))


def rotation_members(lifecycle: DataFrame, events: DataFrame) -> DataFrame:
    """The ids behind each event, one per row: role new, gone or still_active."""
    e = small(events.select("line", "day"))
    role = F.when(F.col("first_seen") == F.col("day"), "new").when(F.col("last_seen") >= F.col("day"), "still_active").otherwise("gone")
    return lifecycle.join(e, "line").where("first_seen <= day").select("line", "day", "route_id", role.alias("role"))


def reappearances(obs: DataFrame, gap: int = ABSENCE_DAYS) -> DataFrame:
    """Ids that came back after more than ``gap`` days, with all directions they ever had."""
    days = active_days(obs)
    directions = days.groupBy(*ROUTE).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("dirs")))).alias("direction_ids"))
    prev = F.lag("day").over(Window.partitionBy(*ROUTE).orderBy("day"))
    return (
        days.select(*ROUTE, "day").withColumn("disappeared_after", prev)
        .withColumn("gap_days", F.datediff("day", "disappeared_after"))
        .where(F.col("gap_days") > gap)
        .withColumnRenamed("day", "reappeared_on")
        .join(directions, ROUTE)
    )


def dual_direction(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.where(F.size("direction_ids") > 1).select(*ROUTE)


def line_last_seen(obs: DataFrame, recent_days: int = 7) -> DataFrame:
    """Last day a line was seen, the next day, and whether that lies in the recent window."""
    per_line = _known(obs).groupBy("line").agg(F.max("day").alias("last_seen"))
    last = per_line.agg(F.max("last_seen").alias("_end")).withColumn("_k", F.lit(0))
    j = per_line.withColumn("_k", F.lit(0)).join(small(last), "_k")
    gone = F.col("last_seen") < F.col("_end")
    return j.select(
        "line",
        "last_seen",
        F.when(gone, F.date_format(F.date_add(F.to_date("last_seen"), 1), "yyyy-MM-dd")).alias("first_not_seen"),
        F.when(~gone, "still active")
        .when(F.datediff("_end", "last_seen") <= recent_days, "cutoff within recent window")
        .otherwise("gone")
        .alias("note"),
    )


def id_pairs(lifecycle: DataFrame) -> DataFrame:
    """Ids N and N+1 of a line whose active spans overlap: do they run opposite directions?"""
    base = lifecycle.withColumn("id", F.expr("try_cast(route_id as long)")).where("id is not null")
    side = lambda p: base.select(
        "line", F.col("id").alias(f"{p}_id"), F.col("direction_ids").alias(f"{p}_dirs"), F.col("first_seen").alias(f"{p}_first"), F.col("last_seen").alias(f"{p}_last")
    )
    a, b = side("a"), side("b").withColumn("a_id", F.col("b_id") - 1)
    return (
        a.join(b, ["line", "a_id"])
        .where("a_first <= b_last and b_first <= a_last")
        .select(
            "line",
            F.col("a_id").alias("route_id"),
            F.col("b_id").alias("next_id"),
            ((F.size("a_dirs") == 1) & (F.size("b_dirs") == 1) & (F.get("a_dirs", F.lit(0)) != F.get("b_dirs", F.lit(0)))).alias("opposite"),
        )
    )


def direction_symmetry(lifecycle: DataFrame, period_days: int = 10) -> DataFrame:
    """Ids per (line, period of first appearance) and direction."""
    period = F.floor(F.datediff(F.to_date("first_seen"), F.lit("1970-01-01").cast("date")) / period_days)
    return (
        lifecycle.withColumn("period", period.cast("long"))
        .select("line", "period", F.explode("direction_ids").alias("d"))
        .groupBy("line", "period")
        .pivot("d", [0, 1])
        .agg(F.count(F.lit(1)))
        .select("line", "period", F.coalesce("0", F.lit(0)).alias("n_dir0"), F.coalesce("1", F.lit(0)).alias("n_dir1"))
    )
