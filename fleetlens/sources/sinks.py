"""Training-table layout, manifests and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.scale import small
from fleetlens.schemas import TRAINING_COLUMNS

TRAJ_WIDTH, FLEET_WIDTH = 30, 300


def typed_training(rows: DataFrame) -> DataFrame:
    """Cast to the training schema; array columns must have their fixed width."""
    present = {c for c in rows.columns}
    fixed = {"traj_flat": TRAJ_WIDTH, "fleet_flat": FLEET_WIDTH}
    checked = rows
    for name, width in fixed.items():
        if name in present:
            bad = F.raise_error(F.lit(f"{name} must have {width} numbers"))
            checked = checked.withColumn(name, F.when(F.size(name) == width, F.col(name)).otherwise(bad))
    return checked.select(
        *[F.col(c).cast(t).alias(c) for c, t in TRAINING_COLUMNS if c in present], *[c for c in ("line", "day") if c in present]
    )


def write_training(rows: DataFrame, path: str) -> None:
    """Per (line, day) partitions; a rerun replaces only the partitions it brings.

    Rows are spread by (line, day) and a hash, so a heavy day is written by
    several tasks.
    """
    (
        typed_training(rows)
        .withColumn("_part", F.pmod(F.xxhash64("ramal_id", "seg_idx", "dist_remaining_m", "observed_eta_s"), F.lit(16)))
        .repartition("line", "day", "_part")
        .drop("_part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("line", "day")
        .parquet(path)
    )


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("ignoreCorruptFiles", "true").parquet(path)


def pending_partitions(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """(line, day) pairs not recorded as done; a day without rows counts as done too."""
    return wanted.select("line", "day").distinct().join(small(manifest.select("line", "day").distinct()), ["line", "day"], "left_anti")


def record_done(processed: DataFrame, rows: DataFrame) -> DataFrame:
    """Manifest entries line, day, n_rows for every processed pair, empty ones included."""
    counts = rows.groupBy("line", "day").agg(F.count(F.lit(1)).alias("n_rows"))
    return processed.select("line", "day").distinct().join(counts, ["line", "day"], "left").fillna(0, ["n_rows"])


LOG = "line string, day string, n_rows long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all committed runs; none before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LOG).parquet(path) if there else spark.createDataFrame([], LOG)


def build_pending(wanted: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, log: str) -> DataFrame:
    """One run of the incremental build; the log entries it adds.

    ``make`` derives the training rows of the (line, day) pairs it is given. Pairs that the log holds are left out. Their
    partitions are written first, replacing what a broken run may have left there; the run counts
    as soon as its entries are appended, which a single commit of the writer does.
    """
    spark = wanted.sparkSession
    todo = pending_partitions(wanted, read_log(spark, log))
    known = [tuple(r) for r in todo.collect()]  # pairs of a line and a day: one run's worth of partitions
    if not known:
        return spark.createDataFrame([], LOG)
    todo = spark.createDataFrame(known, "line string, day string")
    write_training(make(todo), path)
    # partition values come back as dates where they look like dates
    back = spark.read.parquet(path).select(F.col("line").cast("string").alias("line"), F.date_format(F.to_date("day"), "yyyy-MM-dd").alias("day"))
    record_done(todo, back.join(small(todo), ["line", "day"], "left_semi")).select("line", "day", "n_rows").write.mode("append").parquet(log)
    return read_log(spark, log).join(small(todo), ["line", "day"], "left_semi")


def list_done_days(manifest: DataFrame, lines: list[str]) -> DataFrame:
    return manifest.where(F.col("line").isin(lines)).select("day").distinct().orderBy("day")


def trips_summary(parts: list[DataFrame]) -> DataFrame:
    """Union of per-day trip tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_nested_json(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """One JSON text per outer key: {outer: {inner: value}}.

    For report tables whose inner lists are bounded (buckets of a branch,
    entries of a line).
    """
    entry = F.struct(F.col(inner).cast("string").alias("key"), F.col(value).alias("value"))
    return (
        df.groupBy(F.col(outer).cast("string").alias(outer))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
        .select(outer, F.to_json(F.map_from_arrays(F.array(outer), F.array("m"))).alias("json"))
    )


def write_json_lines(docs: DataFrame, path: str, column: str = "json") -> None:
    docs.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
