"""Aggregate ETA models and their evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.calendar import decode_hour, local_hour, monday_weekday
from fleetlens.functions.values import share
from fleetlens.operators.features import SEGMENT_M, segment_index
from fleetlens.operators.scale import exact_quantiles, small

# fixed values
MIN_SPEED = 0.5
MAX_ETA_S = 7200.0
DEFAULT_SPEED = 7.0
PRIOR_HEADWAY_S = 600.0
CONFIDENCE = ["high", "medium", "low"]
DISTANCE_EDGES = [100, 250, 500, 1000, 2000, 5000]
ETA_EDGES = [60, 120, 180, 300, 600]


def with_hour(train: DataFrame) -> DataFrame:
    """Hour decoded (rounded) from the stored single-precision circle position."""
    return train.withColumn(
        "hour", decode_hour(F.col("hour_sin").cast("float").cast("double"), F.col("hour_cos").cast("float").cast("double"))
    )


def fit_speed_lookup(train: DataFrame) -> DataFrame:
    """Mean speed at four levels: level, ramal_id, seg_idx, hour, dow, avg_speed, n.

    The training table is scanned once: sums per finest key first, the coarser
    levels from those.
    """
    usable = with_hour(train.where((F.col("observed_eta_s") > 0) & (F.col("dist_remaining_m") > 0)))
    fine = usable.groupBy("ramal_id", "seg_idx", "hour", F.col("dow").cast("int").alias("dow")).agg(
        F.sum(F.col("dist_remaining_m") / F.col("observed_eta_s")).alias("s"), F.count(F.lit(1)).alias("c")
    )
    b, s, h, d = (F.col(c) for c in ("ramal_id", "seg_idx", "hour", "dow"))
    levels = fine.groupingSets([[b, s, h, d], [b, h, d], [b, h], [b]], b, s, h, d).agg(
        F.grouping_id().alias("_g"), F.sum("s").alias("_s"), F.sum("c").alias("n")
    )
    # bits of grouping_id: seg_idx = 4, hour = 2, dow = 1
    level = F.when(F.col("_g") == 0, 1).when(F.col("_g") == 4, 2).when(F.col("_g") == 5, 3).otherwise(4)
    return (
        levels.select(level.alias("level"), "ramal_id", "seg_idx", "hour", "dow", (F.col("_s") / F.col("n")).alias("avg_speed"), "n")
        .where("avg_speed > 0")
    )


def save_lookup(lookup: DataFrame, path: str) -> None:
    lookup.write.mode("overwrite").parquet(path)


def load_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def model_branches(lookup: DataFrame) -> DataFrame:
    return lookup.where("level in (1, 4) and ramal_id is not null").select("ramal_id").distinct().orderBy("ramal_id")


def _level(lookup: DataFrame, n: int, keys: list[str], out: str) -> DataFrame:
    return small(lookup.where(F.col("level") == n).select(*keys, F.col("avg_speed").alias(out)))


def lookup_speed(keys: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add speed and confidence for (ramal_id, seg_idx, hour, dow), coarser levels as fallback."""
    j = keys.join(_level(lookup, 1, ["ramal_id", "seg_idx", "hour", "dow"], "_1"), ["ramal_id", "seg_idx", "hour", "dow"], "left")
    j = j.join(_level(lookup, 2, ["ramal_id", "hour", "dow"], "_2"), ["ramal_id", "hour", "dow"], "left")
    j = j.join(_level(lookup, 3, ["ramal_id", "hour"], "_3"), ["ramal_id", "hour"], "left")
    j = j.join(_level(lookup, 4, ["ramal_id"], "_4"), "ramal_id", "left")
    return (
        j.withColumn("avg_speed", F.coalesce("_1", "_2", "_3", "_4", F.lit(DEFAULT_SPEED)))
        .withColumn("confidence", F.when(F.col("_1").isNotNull(), "high").when(F.coalesce("_2", "_3").isNotNull(), "medium").otherwise("low"))
        .drop("_1", "_2", "_3", "_4")
    )


def speed_profiles(lookup: DataFrame) -> DataFrame:
    """Per (branch, hour, weekday): speeds by segment and their running travel times.

    ``speeds[i]`` is the speed of segment i (the level-2 speed where a segment
    is unknown), ``cum[i]`` the time over the segments before i, ``gaps[i]`` the
    number of unknown ones before i. An array has one entry per 500 m of the branch.
    """
    base = lookup.where("level = 2").select("ramal_id", "hour", "dow", F.col("avg_speed").alias("base"))
    known = (
        lookup.where("level = 1")
        .groupBy("ramal_id", "hour", "dow")
        .agg(F.map_from_entries(F.collect_list(F.struct("seg_idx", "avg_speed"))).alias("_m"), F.max("seg_idx").alias("_top"))
    )
    index = F.sequence(F.lit(0), F.col("_top"))
    p = known.join(base, ["ramal_id", "hour", "dow"]).withColumns(
        {
            "speeds": F.transform(index, lambda i: F.coalesce(F.try_element_at("_m", i), F.col("base"))),
            "_gap": F.transform(index, lambda i: F.when(F.map_contains_key("_m", i), 0).otherwise(1)),
        }
    )
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    times = F.transform("speeds", lambda v: F.lit(SEGMENT_M) / F.greatest(v, F.lit(MIN_SPEED)))
    return p.select(
        "ramal_id",
        "hour",
        "dow",
        "speeds",
        F.aggregate(times, F.array(F.lit(0.0)), grow).alias("cum"),
        F.aggregate("_gap", F.array(F.lit(0)), grow).alias("gaps"),
    )


def predict_eta(requests: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add eta_s and confidence to rows of (ramal_id, from_m, to_m, hour, dow).

    The way is walked in 500 m steps from the vehicle; step k lies in segment
    first + k. Running times per branch turn the walk into two array lookups
    and the last, partial step, so a request stays one row whatever its length.
    """
    j = requests.join(small(speed_profiles(lookup)), ["ramal_id", "hour", "dow"], "left")
    j = j.join(_level(lookup, 2, ["ramal_id", "hour", "dow"], "_2"), ["ramal_id", "hour", "dow"], "left")
    j = j.join(_level(lookup, 3, ["ramal_id", "hour"], "_3"), ["ramal_id", "hour"], "left")
    j = j.join(_level(lookup, 4, ["ramal_id"], "_4"), "ramal_id", "left")
    dist = F.col("to_m") - F.col("from_m")
    j = j.withColumns(
        {
            "_base": F.greatest(F.coalesce("_2", "_3", "_4", F.lit(DEFAULT_SPEED)), F.lit(MIN_SPEED)),
            "_first": segment_index(F.col("from_m")),
            "_full": (F.ceil(F.greatest(dist, F.lit(1.0)) / SEGMENT_M) - 1).cast("int"),
            "_n": F.size("speeds"),
        }
    )
    last = F.col("_first") + F.col("_full")

    def running(arr: str, i: Column, per_step: Column) -> Column:
        # beyond the known segments every step costs the same
        return F.get(arr, F.least(i, F.col("_n"))) + F.greatest(i - F.col("_n"), F.lit(0)) * per_step

    per_step = F.lit(SEGMENT_M) / F.col("_base")
    rest = dist - F.col("_full") * SEGMENT_M
    end_speed = F.greatest(F.coalesce(F.get("speeds", last), F.col("_base")), F.lit(MIN_SPEED))
    walked = running("cum", last, per_step) - running("cum", F.col("_first"), per_step) + rest / end_speed
    unknown = running("gaps", last + 1, F.lit(1)) - running("gaps", F.col("_first"), F.lit(1))
    has = F.col("speeds").isNotNull()
    coarse = F.when(F.coalesce("_2", "_3").isNotNull(), 1).otherwise(2)
    rank = F.when(has, F.when(unknown > 0, 1).otherwise(0)).otherwise(coarse)
    eta = F.when(has, walked).otherwise(dist / F.col("_base"))
    ahead = dist > 0
    return (
        j.withColumn("eta_s", F.when(ahead, F.least(eta, F.lit(MAX_ETA_S))).otherwise(0.0))
        .withColumn("confidence", F.get(F.array(*[F.lit(c) for c in CONFIDENCE]), F.when(ahead, rank).otherwise(0)))
        .drop("speeds", "cum", "gaps", "_2", "_3", "_4", "_base", "_first", "_full", "_n")
    )


def at_time(requests: DataFrame, ts: str = "ts") -> DataFrame:
    """Serving-time keys: truncated local hour and weekday of a timestamp."""
    return requests.withColumn("hour", local_hour(F.col(ts))).withColumn("dow", monday_weekday(F.col(ts)))


def predict_training_rows(rows: DataFrame, lookup: DataFrame, from_position: bool = False) -> DataFrame:
    """Predictions for training-table rows, from distance 0 or from the row's own segment.

    The hour is decoded half-to-even here, as the evaluation does.
    """
    angle = F.atan2(F.col("hour_sin").cast("float").cast("double"), F.col("hour_cos").cast("float").cast("double"))
    usable = rows.where((F.col("observed_eta_s") > 0) & (F.col("dist_remaining_m") > 0))
    start = F.col("seg_idx") * SEGMENT_M if from_position else F.lit(0.0)
    asked = (
        usable.withColumn("hour", F.pmod(F.bround(angle * 24 / 6.283185307179586).cast("int"), F.lit(24)))
        .withColumn("dow", F.col("dow").cast("int"))
        .withColumn("from_m", start)
        .withColumn("to_m", start + F.col("dist_remaining_m"))
    )
    return predict_eta(asked, lookup).withColumn("err", F.abs(F.col("eta_s") - F.col("observed_eta_s")))


def _bucket3(dist: Column) -> Column:
    return F.when(dist <= 500, "0_500m").when(dist <= 2000, "500m_2km").otherwise("2km_plus")


def evaluate_eta(pred: DataFrame) -> DataFrame:
    """One row: MAE, minutes, size, negatives, MAE by distance and p50/p90/p99 by index."""
    near = _bucket3(F.col("dist_remaining_m"))
    m = pred.agg(
        F.avg("err").alias("mae_s"),
        (F.avg("err") / 60).alias("mae_min"),
        F.count(F.lit(1)).alias("n_val"),
        F.sum(F.when(F.col("eta_s") < 0, 1).otherwise(0)).alias("n_negative"),
        *[F.avg(F.when(near == b, F.col("err"))).alias(f"mae_{b}") for b in ("0_500m", "500m_2km", "2km_plus")],
    )
    q = exact_quantiles(pred, [], "err", {"p50_s": 0.5, "p90_s": 0.9, "p99_s": 0.99}, width=1.0, method="index", narrow=True)
    return m.withColumn("_k", F.lit(0)).join(q.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")


def fit_report(train: DataFrame, val: DataFrame) -> DataFrame:
    """Sizes, metrics and branch list of one fit."""
    lookup = fit_speed_lookup(train)
    metrics = evaluate_eta(predict_training_rows(val, lookup))
    sizes = train.agg(F.count(F.lit(1)).alias("n_train"))
    # branch ids are bounded by the shapes table
    ids = model_branches(lookup).agg(F.array_sort(F.collect_list("ramal_id")).alias("ramal_ids"))
    one = lambda df: df.withColumn("_k", F.lit(0))
    return one(sizes).join(one(metrics), "_k").join(one(ids), "_k").drop("_k")


def confidence_share(pred: DataFrame) -> DataFrame:
    return pred.agg(*[share(F.col("confidence") == c).alias(f"share_{c}") for c in CONFIDENCE])


def naive_mae(rows: DataFrame) -> DataFrame:
    naive = F.col("dist_remaining_m") / F.lit(DEFAULT_SPEED)
    return rows.agg(F.avg(F.abs(naive - F.col("observed_eta_s"))).alias("naive_mae_s"), F.count(F.lit(1)).alias("n"))


def pinball_loss(pred: DataFrame) -> DataFrame:
    """Mean quantile loss; q rises from 0.5 to 0.8 as the bus comes within 1 km."""
    q = F.lit(0.5) + F.lit(0.3) * F.least(F.greatest(F.lit(1.0) - F.col("dist_remaining_m") / 1000.0, F.lit(0.0)), F.lit(1.0))
    e = F.col("observed_eta_s") - F.col("eta_s")
    return pred.agg(F.avg(F.when(e >= 0, q * e).otherwise((q - 1.0) * e)).alias("pinball_s"), F.count(F.lit(1)).alias("n"))


def bucket_metrics(pred: DataFrame) -> DataFrame:
    """MAE by distance, share of underestimates up to 500 m and the naive MAE."""
    d = F.col("dist_remaining_m")
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("err"))), F.lit(0.0))
    under = F.avg(F.when(d <= 500, F.when(F.col("eta_s") < F.col("observed_eta_s"), 1.0).otherwise(0.0)))
    return pred.agg(
        mean(d <= 500).alias("mae_0_500m"),
        mean((d > 500) & (d <= 2000)).alias("mae_500m_2km"),
        mean(d > 2000).alias("mae_2km_plus"),
        F.coalesce(under, F.lit(0.0)).alias("under_500m_ratio"),
        F.avg(F.abs(d / F.lit(DEFAULT_SPEED) - F.col("observed_eta_s"))).alias("naive_mae"),
    )


def _edge_bucket(c: Column, edges: list[int]) -> Column:
    """Left edge of the half-open bucket the value falls in; -1 below the first edge."""
    out = F.when(c < edges[0], -1)
    for low, high in zip(edges, edges[1:]):
        out = out.when(c < high, low)
    return out.otherwise(edges[-1])


def error_by_bucket(pred: DataFrame, by: str = "dist_remaining_m", edges: list[int] | None = None) -> DataFrame:
    """bucket, n, MAE, P50, P90, bias and underestimate percentage per bucket of ``by``."""
    b = pred.withColumn("bucket", _edge_bucket(F.col(by), edges or DISTANCE_EDGES))
    signed = F.col("eta_s") - F.col("observed_eta_s")
    m = b.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("err").alias("mae_s"),
        F.avg(signed).alias("bias_s"),
        (F.avg(F.when(signed < 0, 1.0).otherwise(0.0)) * 100).alias("under_pct"),
    )
    return m.join(exact_quantiles(b, ["bucket"], "err", {"p50_s": 0.5, "p90_s": 0.9}, width=1.0, narrow=True), "bucket")


def threshold_grid(pred: DataFrame, etas: list[int], dists: list[int], arriving_s: float = 90.0) -> DataFrame:
    """Precision, recall, F1 and F2 of "arriving" flags for each (eta, distance) threshold pair.

    All pairs are counted in one pass: one conditional counter per grid cell.
    """
    real = F.col("observed_eta_s") < arriving_s
    grid = [(t, d) for t in etas for d in dists]
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    flag = lambda t, d: (F.col("eta_s") < t) | (F.col("dist_remaining_m") < d)
    totals = pred.agg(
        count(real).alias("_real"),
        *[count(flag(t, d)).alias(f"_f{i}") for i, (t, d) in enumerate(grid)],
        *[count(flag(t, d) & real).alias(f"_h{i}") for i, (t, d) in enumerate(grid)],
    )
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("eta_threshold"), F.lit(d).alias("dist_threshold"), F.col(f"_f{i}").alias("n_flag"), F.col(f"_h{i}").alias("n_hit"))
            for i, (t, d) in enumerate(grid)
        ]
    )
    g = totals.select("_real", F.explode(cells).alias("c")).select("_real", "c.*")
    p = F.when(F.col("n_flag") > 0, F.col("n_hit") / F.col("n_flag")).otherwise(0.0)
    rc = F.when(F.col("_real") > 0, F.col("n_hit") / F.col("_real")).otherwise(0.0)
    g = g.withColumn("precision", p).withColumn("recall", rc)
    fb = lambda b2: F.when(
        F.col("precision") * b2 + F.col("recall") > 0,
        (1 + b2) * F.col("precision") * F.col("recall") / (F.col("precision") * b2 + F.col("recall")),
    ).otherwise(0.0)
    return g.withColumn("f1", fb(1)).withColumn("f2", fb(4)).drop("_real", "n_flag", "n_hit")


REGRESSION_INPUTS = ["dist_remaining_m", "speed_mps", "hour_sin", "hour_cos", "dow"]


def fit_regression(train: DataFrame, kind: str = "linear", inputs: list[str] | None = None, **params) -> PipelineModel:
    """Learned ETA regression, fitted on the cluster: "linear" or "gbt"."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    cols = inputs or REGRESSION_INPUTS
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col("observed_eta_s").cast("double").alias("label"))
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "eta_s"}
    model = GBTRegressor(**common, seed=params.pop("seed", 7), **params) if kind == "gbt" else LinearRegression(**common, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), model]).fit(rows)


def score(rows: DataFrame, model: PipelineModel) -> DataFrame:
    cols = model.stages[0].getInputCols()
    typed = rows.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in rows.columns])
    return model.transform(typed).drop("features").withColumn("err", F.abs(F.col("eta_s") - F.col("observed_eta_s")))


def compare_runs(runs: DataFrame) -> DataFrame:
    """Best epoch and value per run from (run, history) rows."""
    best = F.array_min(F.transform("history", lambda h: F.struct(h["val_mae_s"].alias("v"), h["epoch"].alias("e"))))
    return runs.select(
        "run", "model", best["e"].alias("best_epoch"), best["v"].alias("best_val_s"), F.size("history").alias("n_epochs")
    ).withColumn("rank", F.row_number().over(Window.orderBy("best_val_s", "run")))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Metrics files, one document each; the run is the folder ``run=...`` a file lies in, else its name."""
    from fleetlens.schemas import RUN_METRICS_JSON

    files = spark.read.schema(RUN_METRICS_JSON).json(path, multiLine=True)
    return files if "run" in files.columns else files.withColumn("run", F.col("_metadata.file_name"))
