"""Fleet registry and vehicle age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.filters import resolve_line_agency

# fixed values: plate series by year
NEW_SERIES = [
    (0, 2016), (1000, 2017), (2000, 2017), (2200, 2018), (3000, 2018), (3400, 2019), (4000, 2019), (4100, 2020), (4600, 2021),
    (5000, 2021), (5150, 2022), (5600, 2022), (5800, 2023), (6000, 2023), (6450, 2024), (7000, 2024), (7236, 2025), (8000, 2025),
]
OLD_SERIES = [("JN", 2011), ("KU", 2012), ("MB", 2013), ("NM", 2014), ("ON", 2015), ("PM", 2016)]
OLD_SERIES_START = 2010
LAST_YEAR_10 = 2015
LAST_YEAR_13 = 2012
MIN_VEHICLES = 10
# fixed values: lines under city jurisdiction
CITY_LINES = [
    "4", "7", "12", "25", "26", "34", "39", "42", "44", "47", "50", "61", "62", "64", "65", "68", "76", "84", "102", "106",
    "107", "108", "109", "115", "118", "132", "151",
]


def _series(value: Column, steps: list[tuple], start) -> Column:
    out = F.lit(start)
    for low, year in steps:
        out = F.when(value >= F.lit(low), F.lit(year)).otherwise(out)
    return out


def plate_year(plate: Column) -> Column:
    """Estimated registration year; null for an unknown plate format."""
    p = F.upper(F.replace(plate, F.lit("-"), F.lit("")))
    letter = lambda i: F.ascii(F.substring(p, i, 1)) - 65
    score = letter(1) * 26000 + letter(2) * 1000 + F.substring(p, 3, 3).try_cast("int")
    return F.when(p.rlike(r"^[A-Z]{2}\d{3}[A-Z]{2}$"), _series(score, NEW_SERIES, NEW_SERIES[0][1])).when(
        p.rlike(r"^[A-Z]{3}\d{3}$"), _series(F.substring(p, 1, 2), OLD_SERIES, OLD_SERIES_START)
    )


def estimate_year(df: DataFrame, plate: str = "plate", out: str = "est_year") -> DataFrame:
    return df.withColumn(out, plate_year(F.col(plate)))


def sighted_plates(sightings: DataFrame, order: str = "seq") -> DataFrame:
    """plate, first label, first and last day and number of days seen; blank plates and labels are ignored."""
    clean = sightings.select(F.trim("plate").alias("plate"), F.trim("label").alias("label"), "day", order).where("plate <> '' and label <> ''")
    per_day = clean.groupBy("plate", "day").agg(F.min_by("label", order).alias("label"))
    return per_day.groupBy("plate").agg(
        F.min_by("label", "day").alias("label"),
        F.min("day").alias("first_seen"),
        F.max("day").alias("last_seen"),
        F.count(F.lit(1)).alias("n_days"),
    )


def upsert_registry(registry: DataFrame, sightings: DataFrame, label_map: DataFrame, order: str = "seq") -> DataFrame:
    """New plates enter with line, label, agency and year; known ones only get a later last_seen.

    Sightings are reduced to one row per plate before they meet the registry.
    """
    fresh = estimate_year(resolve_line_agency(sighted_plates(sightings, order), label_map)).drop("n_days")
    cols = ["line", "label", "agency", "est_year", "first_seen"]
    n = fresh.select("plate", F.struct(*cols, "last_seen").alias("n"))
    o = registry.select("plate", F.struct(*cols, "last_seen").alias("o"))
    kept = lambda c: F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return o.join(n, "plate", "full_outer").select(
        "plate", *[kept(c) for c in cols], F.greatest("o.last_seen", "n.last_seen").alias("last_seen")
    )


def upsert_counts(registry: DataFrame, sightings: DataFrame) -> DataFrame:
    """Plates added and (plate, day) pairs that raised last_seen."""
    clean = sightings.where("trim(plate) <> '' and trim(label) <> ''").select(F.trim("plate").alias("plate"), "day").distinct()
    known = clean.join(registry.select("plate", F.col("last_seen").alias("_old")), "plate", "left")
    per = known.groupBy("plate").agg(
        F.max("_old").alias("_old"), F.count(F.lit(1)).alias("_days"), F.sum(F.when(F.col("day") > F.col("_old"), 1).otherwise(0)).alias("_later")
    )
    new = F.col("_old").isNull()
    return per.agg(
        F.sum(F.when(new, 1).otherwise(0)).alias("added"),
        F.sum(F.when(new, F.col("_days") - 1).otherwise(F.col("_later"))).alias("updated"),
    )


def log_run(runs: DataFrame, counts: DataFrame, run_date: str, mode: str, start: str, end: str) -> DataFrame:
    entry = counts.select(
        F.lit(run_date).alias("date"), F.lit(mode).alias("mode"), F.array(F.lit(start), F.lit(end)).alias("range"), "added"
    )
    return runs.unionByName(entry)


def registry_summary(registry: DataFrame) -> DataFrame:
    has = F.coalesce(F.col("line"), F.lit("")) != ""
    per_line = registry.groupBy(F.when(has, F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    on = F.col("line").isNotNull()
    return per_line.agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias("n_with_line"),
        F.sum(F.when(on, 1).otherwise(0)).alias("n_lines"),
        F.coalesce(F.sum(F.when(~on, F.col("n"))), F.lit(0)).alias("n_without_line"),
    )


def age_by_line(registry: DataFrame) -> DataFrame:
    """Size, old vehicles, shares, mean, newest and oldest year per line; plates without year or line are left out."""
    y = F.col("est_year")
    known = registry.where("line is not null and est_year is not null")
    s = known.groupBy("line").agg(
        F.max_by("agency", F.struct("first_seen", "plate")).alias("agency"),
        F.count(F.lit(1)).alias("n_total"),
        F.sum(F.when(y <= LAST_YEAR_10, 1).otherwise(0)).alias("n_old10"),
        F.sum(F.when(y <= LAST_YEAR_13, 1).otherwise(0)).alias("n_old13"),
        F.bround(F.sum(y) / F.count(F.lit(1)), 1).alias("avg_year"),
        F.max(y).alias("newest"),
        F.min(y).alias("oldest"),
    )
    share = lambda c: F.bround(F.col(c) / F.col("n_total") * 100, 1)
    return s.withColumn("pct_old10", share("n_old10")).withColumn("pct_old13", share("n_old13"))


def line_plates(registry: DataFrame) -> DataFrame:
    """Plates per line with their year, oldest first, as rows."""
    known = registry.where("line is not null and est_year is not null")
    return known.select("line", F.col("est_year").alias("year"), "plate").orderBy("line", "year", "plate")


def rank_lines(stats: DataFrame, min_n: int = MIN_VEHICLES) -> DataFrame:
    """Rank by old share (descending), then mean year; smaller lines get no rank and follow in numeric order.

    One row per line: the single ordered window is bounded by the line list.
    """
    big = F.col("n_total") >= min_n
    number = F.coalesce(F.expr("try_cast(line as int)"), F.lit(9999))
    ranked = Window.partitionBy(big).orderBy(
        F.when(big, -F.col("pct_old10")), F.when(big, F.col("avg_year")), number, "line"
    )
    return stats.withColumn("included", big).withColumn("place", F.row_number().over(ranked)).withColumn(
        "rank", F.when(big, F.col("place"))
    )


def tiers(stats: DataFrame) -> DataFrame:
    """Severity by old share and compliance by mean year."""
    p = F.col("pct_old10")
    return stats.withColumn("severity", F.when(p >= 50, "high").when(p >= 20, "medium").otherwise("low")).withColumn(
        "compliance", year_tier(F.col("avg_year"))
    )


def year_tier(year: Column) -> Column:
    return F.when(year <= LAST_YEAR_13, "beyond_13").when(year <= LAST_YEAR_10, "beyond_10").otherwise("within")


def year_histogram(registry: DataFrame) -> DataFrame:
    known = registry.where("est_year is not null")
    return known.groupBy(F.col("est_year").alias("year")).agg(F.count(F.lit(1)).alias("n")).withColumn("tier", year_tier(F.col("year")))


def fleet_kpis(stats: DataFrame, lines: list[str] = CITY_LINES) -> DataFrame:
    """Totals and old shares over all ranked lines and over the given ones."""
    scoped = stats.where("included").select(
        F.explode(F.when(F.col("line").isin(lines), F.array(F.lit("all"), F.lit("city"))).otherwise(F.array(F.lit("all")))).alias("scope"),
        "n_total", "n_old10", "n_old13",
    )
    g = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("n_total").alias("n_total"), F.sum("n_old10").alias("n_old10"), F.sum("n_old13").alias("n_old13")
    )
    rate = lambda c: F.bround(F.col(c) / F.col("n_total") * 100, 1)
    return g.withColumn("pct_old10", rate("n_old10")).withColumn("pct_old13", rate("n_old13"))


def top_lines(ranked: DataFrame, n: int = 5, lines: list[str] = CITY_LINES) -> DataFrame:
    """Worst n by rank, best n by mean year, and the city ranking, as (list, place, line)."""
    big = ranked.where("included")
    worst = big.where(F.col("rank") <= n).select(F.lit("worst").alias("list"), F.col("rank").alias("place"), "line")
    by_year = Window.orderBy(F.col("avg_year").desc(), "rank")
    best = big.withColumn("place", F.row_number().over(by_year)).where(F.col("place") <= n).select(F.lit("best").alias("list"), "place", "line")
    by_share = Window.orderBy("pct_old10", "rank")
    city = big.where(F.col("line").isin(lines)).withColumn("place", F.row_number().over(by_share)).select(F.lit("city").alias("list"), "place", "line")
    return worst.unionByName(best).unionByName(city)
