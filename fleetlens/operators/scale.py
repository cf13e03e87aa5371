"""Building blocks that keep every key splittable.

A vehicle, a route or a shape may own a third of the input, so no operator
orders or ranks a whole key inside one task. Ordered work is cut in buckets
(time or distance); each bucket is ordered on its own and the few facts that
cross a border travel through a per-bucket summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import shared_dir

BROADCAST_LIMIT_BYTES = 64 << 20
BROADCAST_LIMIT_ROWS = 200_000
BUCKET_LIMIT = 1 << 20
# asked to narrow, a bucket with more different values than this is cut by digits before it is ordered
SORTED_VALUES = 1 << 16
DIGIT_BITS = 16
HOUR_S = 3600


_MEASURED: dict[tuple[str, int], bool] = {}


def is_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES, max_rows: int = BROADCAST_LIMIT_ROWS) -> bool:
    """Whether a table may be broadcast.

    The optimizer's size is an upper bound for scans, filters, joins and
    aggregates, but not behind an explode or a parsed document. Those are
    measured: at most ``max_rows`` + 1 rows are counted and sized, once per plan.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) > limit:
        return False
    if "Generate " not in plan.toString():
        return True
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash())
    if key not in _MEASURED:
        size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
        seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
        _MEASURED[key] = seen["n"] <= max_rows and (seen["b"] or 0) <= limit
    return _MEASURED[key]


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast for a table checked to be under the limit.

    Beyond it the hint is left out: the join shuffles on its key and adaptive
    execution splits skewed partitions.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, whoever reads them and whichever executor is lost."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket(col: Column, width: float) -> Column:
    return F.floor(col / F.lit(width))


def number_rows(df: DataFrame, keys: Sequence[str], bucket_col: str, order: Sequence[str], out: str) -> DataFrame:
    """Dense 0-based position of every row inside its key, ordered by (bucket, order)."""
    local = Window.partitionBy(*keys, bucket_col).orderBy(*order)
    counts = df.groupBy(*keys, bucket_col).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, bucket_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        df.withColumn("_rank", F.row_number().over(local) - 1)
        .join(base, [*keys, bucket_col])
        .withColumn(out, (F.col("_base") + F.col("_rank")).cast("long"))
        .drop("_base", "_rank")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    bucket_col: str,
    order: Sequence[str],
    fields: Sequence[str],
    out: str,
) -> DataFrame:
    """Attach the previous row's fields as a struct; null on the first row of a key."""
    local = Window.partitionBy(*keys, bucket_col).orderBy(*order)
    payload = F.struct(*fields)
    tails = df.groupBy(*keys, bucket_col).agg(F.max_by(payload, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy(bucket_col)
    heads = tails.select(*keys, bucket_col, F.lag("_tail").over(across).alias("_carry"))
    return (
        df.withColumn(out, F.lag(payload).over(local))
        .join(heads, [*keys, bucket_col])
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
        .drop("_carry")
    )


def running_total(df: DataFrame, keys: Sequence[str], bucket_col: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum inside a key."""
    local = Window.partitionBy(*keys, bucket_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, bucket_col).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, bucket_col, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    return (
        df.withColumn("_run", F.sum(value).over(local))
        .join(base, [*keys, bucket_col])
        .withColumn(out, F.col("_base") + F.col("_run"))
        .drop("_base", "_run")
    )


def bracketing_neighbours(
    queries: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    width: float,
) -> DataFrame:
    """For each query value, the last point strictly below and the first point at or above it.

    ``points`` holds keys, ``at`` and ``tie``; ``queries`` holds keys, ``at``
    and any identifying columns. Adds structs ``below`` and ``above`` of
    (at, tie). Both sides are merged into one ordered scan per (key, bucket).
    """
    ids = [c for c in queries.columns if c not in (*keys, at)]
    key_cols = [F.col(k) for k in keys]
    hit = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    id_type = queries.select(F.struct(*ids).alias("s")).schema["s"].dataType
    merged = points.select(
        *key_cols, F.col(at), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"), hit.alias("_pt"), F.lit(None).cast(id_type).alias("_id")
    ).unionByName(
        queries.select(
            *key_cols, F.col(at), F.lit(0).alias("_kind"), F.lit(None).cast(points.schema[tie].dataType).alias("_tie"),
            F.struct(*ids).alias("_id"),
        ),
        allowMissingColumns=True,
    ).withColumn("_b", bucket(F.col(at), width))
    local = Window.partitionBy(*keys, "_b").orderBy(at, "_kind", "_tie")
    summary = merged.groupBy(*keys, "_b").agg(F.max("_pt").alias("_hi"), F.min("_pt").alias("_lo"))
    across = Window.partitionBy(*keys).orderBy("_b")
    carry = summary.select(
        *keys,
        "_b",
        F.last("_hi", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_from_left"),
        F.first("_lo", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_from_right"),
    )
    found = (
        merged.withColumn("_l", F.last("_pt", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_r", F.first("_pt", ignorenulls=True).over(local.rowsBetween(1, Window.unboundedFollowing)))
        .where("_kind = 0")
        .join(carry, [*keys, "_b"])
    )
    return found.select(
        *keys,
        at,
        *[F.col(f"_id.{c}").alias(c) for c in ids],
        F.coalesce("_l", "_from_left").alias("below"),
        F.coalesce("_r", "_from_right").alias("above"),
    )


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: dict[str, float],
    width: float = 1.0,
    method: str = "linear",
    narrow: bool = False,
) -> DataFrame:
    """Exact quantiles per group without gathering a group.

    Equal values are counted first, a histogram locates the buckets that hold the
    wanted ranks, and only those buckets are ordered. A bucket is ``width`` wide
    within 2^20 widths of zero and 2^-12 of its values or less beyond.
    ``narrow`` is for groups that may crowd more different values than a task
    should order into that: the counted values are stored, buckets measured, and
    large ones cut by the digits of their bits until at most 2^16 values are left.
    The result is the same. ``method``: "linear" interpolates between neighbours, "index" takes the
    element at floor(n·p).
    """
    g = list(groups) or ["_all"]
    names = list(probs)
    if not groups:
        df = df.withColumn("_all", F.lit(0))
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*g, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", _cell(F.col("_v"), width))
    )
    if narrow:
        counted = stored(counted, "quantiles")
    ordered = Window.partitionBy(*g).orderBy("_b")
    hist = (
        counted.groupBy(*g, "_b")
        .agg(F.sum("_n").alias("_bn"), F.count(F.lit(1)).alias("_values"))
        .withColumn("_before", F.coalesce(F.sum("_bn").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*g)))
    )
    targets = _targets(hist, [*g, "_b"], _wanted_ranks(probs, F.col("_total"), method), "_values")
    picked = _standing(counted, targets, g, narrow)
    out = picked.groupBy(*g).agg(*_interpolated(names))
    return out.select(*groups, *names)


def _wanted_ranks(probs: dict[str, float], total: Column, method: str) -> Column:
    wanted = []
    for i, p in enumerate(probs.values()):
        if method == "index":
            lo = F.least(F.floor(total * F.lit(float(p))), total - 1)
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(0).alias("side"), lo.cast("long").alias("rank"), F.lit(0.0).alias("frac")))
            continue
        pos = (total - 1) * F.lit(float(p))
        lo = F.floor(pos)
        frac = pos - lo
        for side in (0, 1):
            rank = F.least(lo + side, total - 1)
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), frac.alias("frac")))
    return F.array(*wanted)


def value_key(x: Column) -> Column:
    """A long that orders doubles as they order themselves: the bits of the magnitude, negative below zero.

    Both zeros give 0; NaN stands above infinity. Every step is exact: scaling by
    a power of two and the difference of two numbers of one binade don't round.
    """
    a = F.abs(x)
    # a logarithm may round across a power of two, so the exponent is corrected by comparison
    guess = F.least(F.floor(F.log2(a)), F.lit(1023)).cast("int")
    guess = guess + F.when(F.pow(F.lit(2.0), guess) > a, -1).otherwise(0)
    exponent = guess + F.when((guess < 1023) & (F.pow(F.lit(2.0), guess + 1) <= a), 1).otherwise(0)
    fraction = a * F.pow(F.lit(2.0), -exponent) - 1.0
    normal = (exponent + 1023).cast("long") * F.lit(1 << 52) + (fraction * float(1 << 52)).cast("long")
    tiny = (a * 2.0**537 * 2.0**537).cast("long")
    size = (
        F.when(F.isnan(x), F.lit((1 << 63) - 1))
        .when(a == float("inf"), F.lit(2047 << 52))
        .when(a < 2.0**-1022, tiny)
        .otherwise(normal)
    )
    return F.when((x < 0) & ~F.isnan(x), -size).otherwise(size)


def _targets(hist: DataFrame, keys: list[str], ranks: Column, values: str) -> DataFrame:
    """Buckets that hold a wanted rank, with what precedes them."""
    inside = F.filter(
        ranks, lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_bn"))
    )
    return hist.select(*keys, "_before", F.col(values).alias("_values"), inside.alias("_want")).where(F.size("_want") > 0)


def _cell(x: Column, width: float) -> Column:
    """Histogram bucket: the multiple of the width, beyond 2^20 widths 4096 steps to each doubling."""
    q = x / F.lit(float(width))
    far = F.floor(F.least(F.log2(F.abs(q)), F.lit(1100.0)) * 4096.0) + BUCKET_LIMIT
    return F.when(q >= BUCKET_LIMIT, far).when(q <= -BUCKET_LIMIT, -far).otherwise(F.floor(q))


def _standing(counted: DataFrame, targets: DataFrame, g: list[str], narrow: bool) -> DataFrame:
    """Values at the wanted ranks: g, _v, i, side, frac. ``counted``: g, _b, _v, _n with each value once.

    To narrow, one number is read first: the most values of a bucket to be ordered. Beyond the
    limit the values' keys are cut by 16 bits after the other, each time keeping only
    the parts that hold a wanted rank; the last cut leaves at most 2^16 values a part.
    """
    keys = [*g, "_b"]
    rows = counted.join(targets.drop("_values"), keys)
    if not narrow or (targets.agg(F.max("_values").alias("n")).first()["n"] or 0) <= SORTED_VALUES:
        return _ordered(rows, keys)
    rows = rows.withColumn("_key", value_key(F.col("_v"))).withColumn("_part", F.lit(0).cast("long"))
    part = [*keys, "_part"]
    for shift in range(64 - DIGIT_BITS, 0, -DIGIT_BITS):
        rows = stored(rows, "quantile-digits")
        digit = F.shiftright("_key", shift)
        hist = rows.groupBy(*part, digit.alias("_digit")).agg(
            F.sum("_n").alias("_bn"), F.first("_before").alias("_base"), F.first("_want").alias("_ranks")
        )
        run = Window.partitionBy(*part).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_bn").over(run), F.lit(0)))
        hist = hist.drop("_part").withColumnRenamed("_digit", "_part").withColumn("_values", F.lit(0))
        kept = _targets(hist, part, F.col("_ranks"), "_values").drop("_values")
        rows = rows.select(*keys, "_v", "_n", "_key", digit.alias("_part")).join(kept, part)
    return _ordered(rows, part)


def _ordered(rows: DataFrame, part: list[str]) -> DataFrame:
    """The wanted ranks of parts small enough to be ordered in one task."""
    run = Window.partitionBy(*part).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    g = [c for c in part if c not in ("_b", "_part")]
    here = F.filter("_want", lambda t: (t["rank"] >= F.col("_at")) & (t["rank"] < F.col("_at") + F.col("_n")))
    return (
        rows.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_n").over(run), F.lit(0)))
        .select(*g, "_v", F.explode(here).alias("_t"))
        .select(*g, "_v", "_t.i", "_t.side", "_t.frac")
    )


def _interpolated(names: list[str]) -> list[Column]:
    out = []
    for i, name in enumerate(names):
        lo = F.max(F.when((F.col("i") == i) & (F.col("side") == 0), F.col("_v")))
        hi = F.max(F.when((F.col("i") == i) & (F.col("side") == 1), F.col("_v")))
        frac = F.max(F.when((F.col("i") == i) & (F.col("side") == 0), F.col("frac")))
        out.append((lo + (F.coalesce(hi, lo) - lo) * frac).alias(name))
    return out


def exact_quantiles_by_day(
    df: DataFrame, groups: Sequence[str], day: str, value: str, probs: dict[str, float], width: float = 1.0
) -> DataFrame:
    """Exact quantiles of everything seen up to each day, for every (group, day) with new rows.

    Histograms are accumulated over days; raw values are revisited only in the
    buckets that hold a wanted rank.
    """
    g = list(groups)
    names = list(probs)
    counted = (
        df.groupBy(*g, day, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", _cell(F.col("_v"), width))
    )
    per_day = counted.groupBy(*g, "_b", day).agg(F.sum("_n").alias("_dn"), F.count(F.lit(1)).alias("_dv"))
    days = per_day.select(*g, F.col(day).alias("_asof")).distinct()
    hist = (
        per_day.join(days, g)
        .where(F.col(day) <= F.col("_asof"))
        .groupBy(*g, "_asof", "_b")
        .agg(F.sum("_dn").alias("_bn"), F.sum("_dv").alias("_values"))
    )
    ga = [*g, "_asof"]
    ordered = Window.partitionBy(*ga).orderBy("_b")
    hist = hist.withColumn(
        "_before", F.coalesce(F.sum("_bn").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_total", F.sum("_bn").over(Window.partitionBy(*ga)))
    targets = _targets(hist, [*ga, "_b"], _wanted_ranks(probs, F.col("_total"), "linear"), "_values")
    seen = (
        counted.join(targets.select(*ga, "_b"), [*g, "_b"])
        .where(F.col(day) <= F.col("_asof"))
        .groupBy(*ga, "_b", "_v")
        .agg(F.sum("_n").alias("_n"))
    )
    picked = _standing(seen, targets, ga, False)
    return picked.groupBy(*ga).agg(*_interpolated(names)).withColumnRenamed("_asof", day)
