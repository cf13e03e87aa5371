"""Day-based selection of training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.scale import small


def ranked_days(rows: DataFrame, day: str = "day") -> DataFrame:
    """day, day_no (1-based) and n_days. One row per calendar day."""
    days = rows.select(day).distinct()
    return days.withColumn("day_no", F.row_number().over(Window.orderBy(day))).withColumn(
        "n_days", F.count(F.lit(1)).over(Window.partitionBy())
    )


def temporal_split(rows: DataFrame, frac: float = 0.8, day: str = "day") -> tuple[DataFrame, DataFrame]:
    """Rows of the first share of the days, and the rest; at least one training day."""
    cut = F.greatest(F.lit(1), F.floor(F.col("n_days") * F.lit(frac)))
    days = ranked_days(rows, day).select(day, (F.col("day_no") <= cut).alias("_train"))
    train = small(days.where("_train").select(day))
    val = small(days.where("not _train").select(day))
    return rows.join(train, day, "left_semi"), rows.join(val, day, "left_semi")
