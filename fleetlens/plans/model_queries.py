"""Speed lookup, predictions and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import eta_models as em
from fleetlens.operators.temporal import temporal_split
from fleetlens.plans import testbed as tb
from fleetlens.plans.feature_queries import eta
from fleetlens.plans.oracle import cte, sql
from fleetlens.plans.registry import query, r, rq
from fleetlens.session import shared_dir

cte(
    "hours",
    """select * exclude (dow), cast(dow as integer) as dow, cast(round(case when a < 0 then a + 24 else a end) as integer) % 24 as hour, ((cast(round_even(a2, 0) as integer) % 24) + 24) % 24 as eval_hour from (
  select *, atan2(cast(cast(hour_sin as float) as double), cast(cast(hour_cos as float) as double))*24/(2*3.14159265) as a,
  atan2(cast(cast(hour_sin as float) as double), cast(cast(hour_cos as float) as double))*24/6.283185307179586 as a2 from eta)""",
    "eta",
)


@query("decode_hour", sql("select vehicle_id, trip_no, p_pos, f_pos, hour from hours", "hours"))
def decode_hour(spark, sf):
    return em.with_hour(eta(spark, sf)).select("vehicle_id", "trip_no", "p_pos", "f_pos", "hour")


def lookup_sql(src: str) -> str:
    return f"""select case grouping(seg_idx)*4 + grouping(hour)*2 + grouping(dow) when 0 then 1 when 4 then 2 when 5 then 3 else 4 end as level, ramal_id, seg_idx, hour, dow,
  avg(dist_remaining_m/observed_eta_s) as avg_speed, count(*) as n from {src} group by grouping sets ((ramal_id, seg_idx, hour, dow), (ramal_id, hour, dow), (ramal_id, hour), (ramal_id))"""


cte("lookup", lookup_sql("hours"), "hours")


def lookup(spark, sf):
    return tb.stage(spark, sf, "lookup", lambda: em.fit_speed_lookup(eta(spark, sf)))


@query("speed_lookup", sql(f"select level, ramal_id, seg_idx, hour, dow, {rq('avg_speed')}, n from lookup", "lookup"))
def speed_lookup(spark, sf):
    return em.fit_speed_lookup(eta(spark, sf)).select("level", "ramal_id", "seg_idx", "hour", "dow", r("avg_speed").alias("avg_speed"), "n")


@query("model_branches", sql("select distinct ramal_id from lookup", "lookup"))
def model_branches(spark, sf):
    return em.model_branches(lookup(spark, sf))


# probe keys: every part, spread over known and unknown branches, segments, hours and days
cte(
    "probes",
    """select p_partkey as probe_id, case p_partkey % 5 when 0 then '39a0' when 1 then '39b1' when 2 then '42a0' when 3 then '39a1' else 'zz' end as ramal_id,
  cast(p_partkey % 17 as integer) as seg_idx, cast(p_partkey % 24 as integer) as hour, cast(p_partkey % 7 as integer) as dow, 120.0::double*(p_partkey % 50) as from_m, 90.0::double*(p_partkey % 97) as to_m from part""",
)


def probes(spark, sf):
    k = F.col("p_partkey")
    return tb.table(spark, sf, "part").select(
        k.alias("probe_id"),
        F.when(k % 5 == 0, "39a0").when(k % 5 == 1, "39b1").when(k % 5 == 2, "42a0").when(k % 5 == 3, "39a1").otherwise("zz").alias("ramal_id"),
        (k % 17).cast("int").alias("seg_idx"),
        (k % 24).cast("int").alias("hour"),
        (k % 7).cast("int").alias("dow"),
        (F.lit(120.0) * (k % 50)).alias("from_m"),
        (F.lit(90.0) * (k % 97)).alias("to_m"),
    )


def speed_sql(src: str, lookup: str, seg: str = "q.seg_idx") -> str:
    return f"""select q.*, coalesce(l1.avg_speed, l2.avg_speed, l3.avg_speed, l4.avg_speed, 7.0) as avg_speed,
  case when l1.avg_speed is not null then 0 when coalesce(l2.avg_speed, l3.avg_speed) is not null then 1 else 2 end as conf from {src} q
  left join {lookup} l1 on l1.level = 1 and l1.ramal_id = q.ramal_id and l1.seg_idx = {seg} and l1.hour = q.hour and l1.dow = q.dow
  left join {lookup} l2 on l2.level = 2 and l2.ramal_id = q.ramal_id and l2.hour = q.hour and l2.dow = q.dow
  left join {lookup} l3 on l3.level = 3 and l3.ramal_id = q.ramal_id and l3.hour = q.hour left join {lookup} l4 on l4.level = 4 and l4.ramal_id = q.ramal_id"""


CONF = "case conf when 0 then 'high' when 1 then 'medium' else 'low' end"
cte("probe_speed", speed_sql("probes", "lookup"), "probes", "lookup")


@query("lookup_speed", sql(f"select probe_id, {rq('avg_speed')}, {CONF} as confidence from probe_speed", "probe_speed"))
def lookup_speed(spark, sf):
    return em.lookup_speed(probes(spark, sf), lookup(spark, sf)).select("probe_id", r("avg_speed").alias("avg_speed"), "confidence")


def walk_sql(src: str, key: str, lookup: str) -> tuple[str, str]:
    """Two CTE bodies: the 500 m steps with their speeds, and the totals per ``key``."""
    # range() over an expression of a lateral row: one step per 500 m
    spread = f"""(select *, cast(floor(from_m/500.0) as integer) + k as seg, least(to_m - from_m - k*500.0::double, 500.0::double) as len from (
      select *, unnest(range(0, cast(ceil((to_m - from_m)/500.0) as bigint))) as k from {src} where to_m > from_m))"""
    steps = speed_sql(spread, lookup, seg="q.seg")
    return steps, f"select {key}, least(sum(len/greatest(avg_speed, 0.5)), 7200.0) as eta_s, max(conf) as conf from {{steps}} group by {key}"


_steps, _total = walk_sql("probes", "probe_id", "lookup")
cte("probe_steps", _steps, "probes", "lookup")
cte("probe_eta", _total.format(steps="probe_steps"), "probe_steps")


@query(
    "predict_eta",
    sql(
        f"select p.probe_id, {rq('coalesce(e.eta_s, 0.0)', 'eta_s', 4)}, {CONF.replace('conf ', 'coalesce(e.conf, 0) ', 1)} as confidence from probes p left join probe_eta e using (probe_id)",
        "probes",
        "probe_eta",
    ),
)
def predict_eta(spark, sf):
    return em.predict_eta(probes(spark, sf), lookup(spark, sf)).select("probe_id", r("eta_s", 4).alias("eta_s"), "confidence")


cte("split_days", "select day, row_number() over (order by day) as n, count(*) over () as total from (select distinct day from eta)", "eta")
cte("split", "select h.*, d.n <= greatest(1, floor(d.total*0.8)) as is_train from hours h join split_days d using (day)", "hours", "split_days")
cte("train_rows", "select * from split where is_train", "split")
cte("val_rows", "select * exclude (hour), eval_hour as hour, 0.0::double as from_m, dist_remaining_m as to_m, row_number() over (order by vehicle_id, trip_no, p_pos, f_pos) as row_id from split where not is_train", "split")
cte("train_lookup", lookup_sql("train_rows"), "train_rows")
_steps, _total = walk_sql("val_rows", "row_id", "train_lookup")
cte("val_steps", _steps, "val_rows", "train_lookup")
cte("val_eta", _total.format(steps="val_steps"), "val_steps")
cte("pred", "select v.*, e.eta_s, e.conf, abs(e.eta_s - v.observed_eta_s) as err from val_rows v join val_eta e using (row_id)", "val_rows", "val_eta")


def split(spark, sf):
    return temporal_split(eta(spark, sf))


def predicted(spark, sf):
    def build():
        train, val = split(spark, sf)
        return em.predict_training_rows(val, em.fit_speed_lookup(train))

    return tb.stage(spark, sf, "predictions", build)


IDX = "(list(err order by err))[cast(floor(count(*)*{q}) as bigint)+1]"


@query(
    "evaluate_eta",
    sql(
        f"""select {rq('avg(err)', 'mae_s', 4)}, {rq('avg(err)/60', 'mae_min', 4)}, count(*) as n_val, cast(sum(case when eta_s < 0 then 1 else 0 end) as bigint) as n_negative,
        {rq('avg(err) filter (dist_remaining_m <= 500)', 'mae_0_500m', 4)}, {rq('avg(err) filter (dist_remaining_m > 500 and dist_remaining_m <= 2000)', 'mae_500m_2km', 4)},
        {rq('avg(err) filter (dist_remaining_m > 2000)', 'mae_2km_plus', 4)}, {rq(IDX.format(q=0.5), 'p50_s', 4)}, {rq(IDX.format(q=0.9), 'p90_s', 4)}, {rq(IDX.format(q=0.99), 'p99_s', 4)} from pred""",
        "pred",
    ),
)
def evaluate_eta(spark, sf):
    m = em.evaluate_eta(predicted(spark, sf))
    return m.select("n_val", "n_negative", *[r(c, 4).alias(c) for c in m.columns if not c.startswith("n_")])


@query(
    "fit_report",
    sql(
        f"""select (select count(*) from train_rows) as n_train, count(*) as n_val, {rq('avg(err)', 'mae_s', 4)},
        (select string_agg(ramal_id, ',' order by ramal_id) from (select distinct ramal_id from train_lookup)) as ramal_ids from pred""",
        "pred",
        "train_rows",
        "train_lookup",
    ),
)
def fit_report(spark, sf):
    return em.fit_report(*split(spark, sf)).select("n_train", "n_val", r("mae_s", 4).alias("mae_s"), F.concat_ws(",", "ramal_ids").alias("ramal_ids"))


@query(
    "confidence_share",
    sql(
        f"select {rq('avg(case when conf = 0 then 1.0 else 0.0 end)', 'share_high')}, {rq('avg(case when conf = 1 then 1.0 else 0.0 end)', 'share_medium')}, {rq('avg(case when conf = 2 then 1.0 else 0.0 end)', 'share_low')} from pred",
        "pred",
    ),
)
def confidence_share(spark, sf):
    s = em.confidence_share(predicted(spark, sf))
    return s.select(*[r(c).alias(c) for c in s.columns])


@query("naive_mae", sql(f"select {rq('avg(abs(dist_remaining_m/7.0 - observed_eta_s))', 'naive_mae_s', 4)}, count(*) as n from eta", "eta"))
def naive_mae(spark, sf):
    return em.naive_mae(eta(spark, sf)).select(r("naive_mae_s", 4).alias("naive_mae_s"), "n")


Q = "(0.5 + 0.3*least(greatest(1.0 - dist_remaining_m/1000.0, 0.0), 1.0))"


@query(
    "pinball_loss",
    sql(
        f"select {rq(f'avg(case when observed_eta_s - eta_s >= 0 then {Q}*(observed_eta_s - eta_s) else ({Q} - 1.0)*(observed_eta_s - eta_s) end)', 'pinball_s', 4)}, count(*) as n from pred",
        "pred",
    ),
)
def pinball_loss(spark, sf):
    return em.pinball_loss(predicted(spark, sf)).select(r("pinball_s", 4).alias("pinball_s"), "n")


@query(
    "bucket_metrics",
    sql(
        f"""select {rq('coalesce(avg(err) filter (dist_remaining_m <= 500), 0)', 'mae_0_500m', 4)}, {rq('coalesce(avg(err) filter (dist_remaining_m > 500 and dist_remaining_m <= 2000), 0)', 'mae_500m_2km', 4)},
        {rq('coalesce(avg(err) filter (dist_remaining_m > 2000), 0)', 'mae_2km_plus', 4)}, {rq('coalesce(avg(case when eta_s < observed_eta_s then 1.0 else 0.0 end) filter (dist_remaining_m <= 500), 0)', 'under_500m_ratio', 4)},
        {rq('avg(abs(dist_remaining_m/7.0 - observed_eta_s))', 'naive_mae', 4)} from pred""",
        "pred",
    ),
)
def bucket_metrics(spark, sf):
    m = em.bucket_metrics(predicted(spark, sf))
    return m.select(*[r(c, 4).alias(c) for c in m.columns])


def _bucket_sql(col: str, edges: list[int]) -> str:
    out = f"case when {col} < {edges[0]} then -1"
    for a, b in zip(edges, edges[1:]):
        out += f" when {col} < {b} then {a}"
    return out + f" else {edges[-1]} end"


def _error_sql(by: str, col: str, edges: list[int]) -> str:
    return f"""select '{by}' as kind, {_bucket_sql(col, edges)} as bucket, count(*) as n, {rq('avg(err)', 'mae_s', 4)}, {rq('avg(eta_s - observed_eta_s)', 'bias_s', 4)},
    {rq('100*avg(case when eta_s < observed_eta_s then 1.0 else 0.0 end)', 'under_pct', 4)}, {rq('quantile_cont(err, 0.5)', 'p50_s', 4)}, {rq('quantile_cont(err, 0.9)', 'p90_s', 4)} from pred group by all"""


@query(
    "error_by_bucket",
    sql(_error_sql("distance", "dist_remaining_m", em.DISTANCE_EDGES) + " union all " + _error_sql("eta", "eta_s", em.ETA_EDGES), "pred"),
)
def error_by_bucket(spark, sf):
    p = predicted(spark, sf)
    both = em.error_by_bucket(p).withColumn("kind", F.lit("distance")).unionByName(
        em.error_by_bucket(p, "eta_s", em.ETA_EDGES).withColumn("kind", F.lit("eta"))
    )
    return both.select("kind", "bucket", "n", *[r(c, 4).alias(c) for c in ("mae_s", "bias_s", "under_pct", "p50_s", "p90_s")])


GRID_T, GRID_D = [90, 120, 150], [200, 250, 300]
F_SQL = "case when {b}*precision + recall > 0 then (1+{b})*precision*recall/({b}*precision + recall) else 0 end"


@query(
    "threshold_grid",
    sql(
        f"""select eta_threshold, dist_threshold, {rq('precision')}, {rq('recall')}, {rq(F_SQL.format(b=1), 'f1')}, {rq(F_SQL.format(b=4), 'f2')} from (
        select t as eta_threshold, d as dist_threshold, coalesce(sum(case when flag and real then 1 else 0 end)/nullif(sum(case when flag then 1 else 0 end), 0), 0.0) as precision,
          coalesce(sum(case when flag and real then 1 else 0 end)/nullif(sum(case when real then 1 else 0 end), 0), 0.0) as recall
        from (select t, d, eta_s < t or dist_remaining_m < d as flag, observed_eta_s < 90 as real from pred, (select unnest([90,120,150])::integer as t), (select unnest([200,250,300])::integer as d)) group by t, d)""",
        "pred",
    ),
)
def threshold_grid(spark, sf):
    g = em.threshold_grid(predicted(spark, sf), GRID_T, GRID_D)
    return g.select("eta_threshold", "dist_threshold", *[r(c).alias(c) for c in ("precision", "recall", "f1", "f2")])


# ordinary least squares on one input has a closed form, which SQL can state
@query(
    "regression_linear",
    sql(
        f"""select vehicle_id, trip_no, p_pos, f_pos, {rq('(select regr_intercept(observed_eta_s, dist_remaining_m) from train_rows) + (select regr_slope(observed_eta_s, dist_remaining_m) from train_rows)*dist_remaining_m', 'eta_s', 2)} from val_rows""",
        "train_rows",
        "val_rows",
    ),
)
def regression_linear(spark, sf):
    train, val = split(spark, sf)
    model = em.fit_regression(train, inputs=["dist_remaining_m"], solver="normal")
    return em.score(val, model).select("vehicle_id", "trip_no", "p_pos", "f_pos", r("eta_s", 2).alias("eta_s"))


# least squares on all inputs: what is left over has no moment with any input or with a constant
INPUTS = [*em.REGRESSION_INPUTS, "constant"]


@query("regression_inputs", sql(f"select input, n, 0.0::double as moment from (select unnest({INPUTS}) as input), (select count(*) as n from train_rows)", "train_rows"))
def regression_inputs(spark, sf):
    """The normal equations of the fitted model, one row per input, relative to the size of their terms."""
    train, _ = split(spark, sf)
    scored = em.score(train, em.fit_regression(train, solver="normal")).withColumn("constant", F.lit(1.0))
    left = F.col("eta_s") - F.col("observed_eta_s")
    terms = [F.struct(F.lit(c).alias("input"), (left * F.col(c)).alias("term")) for c in INPUTS]
    sums = scored.select(F.inline(F.array(*terms))).groupBy("input").agg(F.count(F.lit(1)).alias("n"), F.sum("term").alias("sum"), F.sum(F.abs("term")).alias("size"))
    return sums.select("input", "n", r(F.when(F.col("size") > 0, F.col("sum") / F.col("size")).otherwise(0.0), 5).alias("moment"))


@query(
    "regression_gbt",
    sql(f"select count(*) as n, count(*) as n_finite, {rq('avg(abs(dist_remaining_m/7.0 - observed_eta_s))', 'naive_mae_s', 4)}, true as beats_naive from val_rows", "val_rows"),
)
def regression_gbt(spark, sf):
    """Boosted trees on the plan's inputs, scored on the validation days: every row has a finite ETA, and the mean error is below the naive one."""
    train, val = split(spark, sf)
    scored = em.score(val, em.fit_regression(train, kind="gbt", maxIter=5, maxDepth=3))
    naive = F.avg(F.abs(F.col("dist_remaining_m") / 7.0 - F.col("observed_eta_s")))
    finite = F.count_if(F.col("eta_s").isNotNull() & ~F.isnan("eta_s") & (F.abs("eta_s") < float("inf")))
    return scored.agg(F.count(F.lit(1)).alias("n"), finite.alias("n_finite"), r(naive, 4).alias("naive_mae_s"), (F.avg("err") < naive).alias("beats_naive"))


# one run per line, one epoch per order month: the lowest mean price is the best epoch
cte(
    "epochs",
    "select 'run' || (o_custkey % 8) as run, cast(month(o_orderdate) as integer) as epoch, round(avg(o_totalprice), 4) as val_mae_s from orders group by all",
)


@query(
    "compare_runs",
    sql(
        """select run, 'lookup' as model, best_epoch, best_val_s + 0.0 as best_val_s, cast(n_epochs as integer) as n_epochs, cast(row_number() over (order by best_val_s, run) as integer) as rank from (
        select run, min(val_mae_s) as best_val_s, min_by(epoch, val_mae_s) as best_epoch, count(*) as n_epochs from epochs group by run)""",
        "epochs",
    ),
)
def compare_runs(spark, sf):
    per_epoch = (
        tb.table(spark, sf, "orders")
        .groupBy(F.concat(F.lit("run"), F.col("o_custkey") % 8).alias("run"), F.month("o_orderdate").alias("epoch"))
        .agg(F.round(F.avg("o_totalprice"), 4).alias("val_mae_s"))
    )
    # a run's history holds one entry a month
    runs = per_epoch.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "val_mae_s"))).alias("history"))
    path = shared_dir(spark, "runs")
    runs.select("run", F.to_json(F.struct(F.lit("lookup").alias("model"), "history")).alias("text")).write.partitionBy("run").text(path)
    files = em.read_runs(spark, path)
    return em.compare_runs(files)
