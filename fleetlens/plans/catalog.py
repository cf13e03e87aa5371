"""All registered queries and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import eta_models
from fleetlens.operators import features as fx
from fleetlens.plans import (  # noqa: F401
    arrival_queries,
    capture_queries,
    feature_queries,
    fleet_queries,
    geometry_queries,
    headway_queries,
    model_queries,
    route_queries,
    source_queries,
    stream_queries,
    testbed,
    trip_queries,
)
from fleetlens.plans.registry import ORACLE, QUERIES
from fleetlens.session import tune

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings to arrival times: trips, projection, ETA rows, speed lookup, and the time for 2 km on each branch."""
    tune(spark)
    points = testbed.projected_table(spark, sf_dir)
    feats = feature_queries.timed(fx.point_features(points, arrays=False, store=testbed.stored))
    lookup = testbed.stored(eta_models.fit_speed_lookup(fx.eta_rows(feats, arrays=False)), "lookup")
    asked = lookup.where("level = 2").select("ramal_id", "hour", "dow", F.lit(0.0).alias("from_m"), F.lit(2000.0).alias("to_m"), "n")
    return eta_models.predict_eta(asked, lookup).orderBy("ramal_id", "dow", "hour")
