"""Fleet registry and age; sightings come from orders, one vehicle per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import fleet_age as fa
from fleetlens.plans import testbed as tb
from fleetlens.plans.oracle import cte, sql
from fleetlens.plans.registry import query

cte(
    "fleet_labels",
    "select cast(i as varchar) as suffix, cast(i*13 % 230 + 1 as varchar) as line, 'Agency ' || (i % 4) as agency from (select unnest(range(0, 60)) as i)",
)
PLATE_SQL = """case when k % 10 = 0 then 'X-' || k when k % 3 = 0 then chr(cast(74 + k % 7 as integer)) || chr(cast(65 + k//7 % 26 as integer)) || chr(cast(65 + k % 26 as integer)) || lpad(cast(k % 1000 as varchar), 3, '0')
  else (case when k % 4 = 1 then 'a' else 'A' end) || chr(cast(65 + k % 9 as integer)) || '-' || lpad(cast(k*7 % 1000 as varchar), 3, '0') || '-' || chr(cast(65 + k % 26 as integer)) || chr(cast(65 + k//26 % 26 as integer)) end"""
cte("plates", f"select k, {PLATE_SQL} as plate from (select distinct c_custkey as k from customer)")
cte(
    "sightings",
    f"""select case when o_orderkey % 53 = 0 then ' ' else {PLATE_SQL} end as plate, case when o_orderkey % 59 = 0 then '' else k || '-' || (case when k % 5 < 3 then k % 11 else k % 60 end) end as label,
  strftime(o_orderdate, '%Y-%m-%d') as day, o_orderkey as seq from (select *, o_custkey as k from orders)""",
)


def plate_of(k):
    char = lambda c: F.char(c.cast("long"))
    digits = lambda c: F.lpad((c % 1000).cast("string"), 3, "0")
    div = lambda c, n: F.floor(c / n)
    old = F.concat(char(k % 7 + 74), char(div(k, 7) % 26 + 65), char(k % 26 + 65), digits(k))
    new = F.concat(
        F.when(k % 4 == 1, "a").otherwise("A"), char(k % 9 + 65), F.lit("-"), digits(k * 7), F.lit("-"), char(k % 26 + 65), char(div(k, 26) % 26 + 65)
    )
    return F.when(k % 10 == 0, F.concat(F.lit("X-"), k.cast("string"))).when(k % 3 == 0, old).otherwise(new)


def sightings(spark, sf):
    k, n = F.col("o_custkey"), F.col("o_orderkey")
    suffix = F.when(k % 5 < 3, k % 11).otherwise(k % 60)
    return tb.table(spark, sf, "orders").select(
        F.when(n % 53 == 0, " ").otherwise(plate_of(k)).alias("plate"),
        F.when(n % 59 == 0, "").otherwise(F.concat_ws("-", k, suffix)).alias("label"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        n.alias("seq"),
    )


def labels(spark):
    i = F.col("id")
    return spark.range(60).select(
        i.cast("string").alias("suffix"), (i * 13 % 230 + 1).cast("string").alias("line"), F.concat(F.lit("Agency "), (i % 4).cast("string")).alias("agency")
    )


def year_sql(p: str) -> str:
    new = "".join(f" when s >= {low} then {y}" for low, y in reversed(fa.NEW_SERIES))
    old = "".join(f" when substr(q, 1, 2) >= '{low}' then {y}" for low, y in reversed(fa.OLD_SERIES))
    return f"""(select case when regexp_full_match(q, '[A-Z]{{2}}\\d{{3}}[A-Z]{{2}}') then case{new} end when regexp_full_match(q, '[A-Z]{{3}}\\d{{3}}') then case{old} else 2010 end end
    from (select *, (ascii(substr(q, 1, 1)) - 65)*26000 + (ascii(substr(q, 2, 1)) - 65)*1000 + try_cast(substr(q, 3, 3) as integer) as s from (select upper(replace({p}, '-', '')) as q)))"""


@query("estimate_year", sql(f"select k as plate_id, plate, cast({year_sql('plate')} as integer) as est_year from plates", "plates"))
def estimate_year(spark, sf):
    cars = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("plate_id"), plate_of(F.col("c_custkey")).alias("plate"))
    return fa.estimate_year(cars)


cte("clean", "select trim(plate) as plate, trim(label) as label, day, seq from sightings where trim(plate) <> '' and trim(label) <> ''", "sightings")


def registry_sql(src: str) -> str:
    return f"""select plate, m.line, label, m.agency, cast({year_sql('plate')} as integer) as est_year, first_seen, last_seen from (
  select plate, arg_min(label, (day, seq)) as label, min(day) as first_seen, max(day) as last_seen from {src} group by plate) x
  left join (select * from fleet_labels where cast(line as integer) <= 200) m on m.suffix = split_part(x.label, '-', -1)"""


HALF = "1995-07-01"
cte("early", f"select * from clean where day < '{HALF}'", "clean")
cte("reg0", registry_sql("early"), "early", "fleet_labels")
cte("reg_all", registry_sql("clean"), "clean", "fleet_labels")


def early(spark, sf):
    s = sightings(spark, sf)
    empty = s.limit(0).select(
        "plate", F.lit("").alias("line"), "label", F.lit("").alias("agency"), F.lit(0).alias("est_year"), F.col("day").alias("first_seen"), F.col("day").alias("last_seen")
    )
    return fa.upsert_registry(empty, s.where(F.col("day") < HALF), labels(spark))


def registry(spark, sf):
    """Two runs: the first half of the period, then the rest on top of it."""
    def build():
        old = tb.stored(early(spark, sf), "registry0")
        return fa.upsert_registry(old, sightings(spark, sf).where(F.col("day") >= HALF), labels(spark))

    return tb.stage(spark, sf, "registry", build)


@query("upsert_registry", sql("select plate, line, label, agency, est_year, first_seen, last_seen from reg_all", "reg_all"))
def upsert_registry(spark, sf):
    old = tb.stored(early(spark, sf), "registry0")
    return fa.upsert_registry(old, sightings(spark, sf).where(F.col("day") >= HALF), labels(spark))


cte(
    "counts",
    f"""select cast(sum(case when o is null then 1 else 0 end) as bigint) as added, cast(sum(case when o is null then days - 1 else days end) as bigint) as updated from (
  select c.plate, any_value(g.last_seen) as o, count(distinct c.day) as days from clean c left join reg0 g using (plate) where c.day >= '{HALF}' group by c.plate)""",
    "clean",
    "reg0",
)


@query("upsert_counts", sql("select added, updated from counts", "counts"))
def upsert_counts(spark, sf):
    old = tb.stored(early(spark, sf), "registry0")
    return fa.upsert_counts(old, sightings(spark, sf).where(F.col("day") >= HALF))


@query(
    "log_run",
    sql(
        f"""select '1995-06-30' as date, 'peak' as mode, '1992-01-01..1995-06-30' as range, (select count(*) from reg0) as added
        union all select '2000-01-01', 'all_frames', '{HALF}..1999-12-31', added from counts""",
        "counts",
        "reg0",
    ),
)
def log_run(spark, sf):
    old = tb.stored(early(spark, sf), "registry0")
    runs = old.agg(F.count(F.lit(1)).alias("added")).select(
        F.lit("1995-06-30").alias("date"), F.lit("peak").alias("mode"), F.array(F.lit("1992-01-01"), F.lit("1995-06-30")).alias("range"), "added"
    )
    counts = fa.upsert_counts(old, sightings(spark, sf).where(F.col("day") >= HALF))
    log = fa.log_run(runs, counts, "2000-01-01", "all_frames", HALF, "1999-12-31")
    return log.select("date", "mode", F.concat_ws("..", "range").alias("range"), "added")


@query(
    "registry_summary",
    sql("select count(*) as n_total, count(line) as n_with_line, count(distinct line) as n_lines, count(*) - count(line) as n_without_line from reg_all", "reg_all"),
)
def registry_summary(spark, sf):
    return fa.registry_summary(registry(spark, sf))


cte(
    "ages",
    """select line, arg_max(agency, (first_seen, plate)) as agency, count(*) as n_total, cast(sum(case when est_year <= 2015 then 1 else 0 end) as bigint) as n_old10, cast(sum(case when est_year <= 2012 then 1 else 0 end) as bigint) as n_old13,
  round_even(sum(est_year)/count(*), 1) as avg_year, max(est_year) as newest, min(est_year) as oldest, round_even(sum(case when est_year <= 2015 then 1 else 0 end)/count(*)*100, 1) as pct_old10,
  round_even(sum(case when est_year <= 2012 then 1 else 0 end)/count(*)*100, 1) as pct_old13 from reg_all where line is not null and est_year is not null group by line""",
    "reg_all",
)
AGE_COLS = "line, agency, n_total, n_old10, n_old13, avg_year, newest, oldest, pct_old10, pct_old13"


@query("age_by_line", sql(f"select {AGE_COLS} from ages", "ages"))
def age_by_line(spark, sf):
    return fa.age_by_line(registry(spark, sf)).select(*AGE_COLS.split(", "))


@query(
    "line_plates",
    sql("select line, est_year as year, plate from reg_all where line is not null and est_year is not null", "reg_all"),
)
def line_plates(spark, sf):
    return fa.line_plates(registry(spark, sf))


cte(
    "ranked",
    """select *, case when included then place end as rank from (select *, n_total >= 10 as included, cast(row_number() over (partition by n_total >= 10 order by case when n_total >= 10 then -pct_old10 end, case when n_total >= 10 then avg_year end,
  cast(line as integer), line) as integer) as place from ages)""",
    "ages",
)


def ranked(spark, sf):
    return fa.rank_lines(fa.age_by_line(registry(spark, sf)))


@query("rank_lines", sql("select line, included, place, rank, pct_old10, avg_year from ranked", "ranked"))
def rank_lines(spark, sf):
    return ranked(spark, sf).select("line", "included", "place", "rank", "pct_old10", "avg_year")


@query(
    "fleet_tiers",
    sql(
        """select line, case when pct_old10 >= 50 then 'high' when pct_old10 >= 20 then 'medium' else 'low' end as severity,
        case when avg_year <= 2012 then 'beyond_13' when avg_year <= 2015 then 'beyond_10' else 'within' end as compliance from ages""",
        "ages",
    ),
)
def fleet_tiers(spark, sf):
    return fa.tiers(fa.age_by_line(registry(spark, sf))).select("line", "severity", "compliance")


@query(
    "year_histogram",
    sql(
        "select est_year as year, count(*) as n, case when est_year <= 2012 then 'beyond_13' when est_year <= 2015 then 'beyond_10' else 'within' end as tier from reg_all where est_year is not null group by est_year",
        "reg_all",
    ),
)
def year_histogram(spark, sf):
    return fa.year_histogram(registry(spark, sf))


CITY = ", ".join(f"'{x}'" for x in fa.CITY_LINES)
KPI = """select '{s}' as scope, count(*) as n_lines, cast(sum(n_total) as bigint) as n_total, cast(sum(n_old10) as bigint) as n_old10, cast(sum(n_old13) as bigint) as n_old13,
round_even(sum(n_old10)/sum(n_total)*100, 1) as pct_old10, round_even(sum(n_old13)/sum(n_total)*100, 1) as pct_old13 from ranked where included and {c} having count(*) > 0"""


@query("fleet_kpis", sql(KPI.format(s="all", c="true") + " union all " + KPI.format(s="city", c=f"line in ({CITY})"), "ranked"))
def fleet_kpis(spark, sf):
    return fa.fleet_kpis(ranked(spark, sf))


@query(
    "top_lines",
    sql(
        f"""select 'worst' as list, rank as place, line from ranked where included and rank <= 5
        union all select 'best', place, line from (select *, cast(row_number() over (order by avg_year desc, rank) as integer) as place from ranked where included) where place <= 5
        union all select 'city', cast(row_number() over (order by pct_old10, rank) as integer), line from ranked where included and line in ({CITY})""".replace(
            "select *, cast(row_number() over (order by avg_year desc, rank) as integer) as place", "select line, cast(row_number() over (order by avg_year desc, rank) as integer) as place"
        ),
        "ranked",
    ),
)
def top_lines(spark, sf):
    return fa.top_lines(ranked(spark, sf))
