"""Headway statistics where values crowd or distances repeat."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import headway as hw
from fleetlens.operators import scale


def test_interp_error_of_points_at_one_spot(spark):
    """Standing vehicles give no error row, whichever side of the filter the quotient is evaluated on."""
    rows = [("a", 0, i, 1000 + 10 * i, 50.0) for i in range(6)] + [("b", 0, 10 + i, 1000 + 10 * i, 100.0 * i) for i in range(3)]
    points = spark.createDataFrame(rows, "vehicle_id string, trip_no long, event_id long, ts long, along_m double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = hw.interp_error(points).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got["n"] == 1 and got["mean_s"] == pytest.approx(0.0)


def test_crowded_headways_are_cut_before_they_are_ordered(spark, monkeypatch):
    """Many vehicles leave seconds between passages: all values lie in one bucket of the histogram."""
    purposes, write = [], scale.stored
    monkeypatch.setattr(scale, "stored", lambda df, purpose: purposes.append(purpose) or write(df, purpose))
    monkeypatch.setattr(scale, "SORTED_VALUES", 16)
    rng = random.Random(5)
    values = [rng.random() * 9 for _ in range(400)]
    rows = spark.createDataFrame([(0.0, v) for v in values], "from_s double, headway_s double")
    got = hw.headway_stats(rows).where(F.col("scope") == "all").first()
    assert [got[f"p{p}_s"] for p in (10, 50, 95)] == pytest.approx([np.percentile(values, p) for p in (10, 50, 95)])
    assert "quantile-digits" in purposes
