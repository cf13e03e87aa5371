"""Deterministic telemetry views over the driver's tables.

Every registered query reads one of the given tables through these views, so
its work grows with them. The small companions (shapes, maps) are dimension
data; the same values are stated as SQL in ``oracle.py``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.filters import resolve_line
from fleetlens.operators.geometry import assign_shape, prepared_paths, project_near, project_points
from fleetlens.operators.trips import segment_trips
from fleetlens.session import shared_dir
from fleetlens.sources import shapes as shape_source

# fixed values: end points of the straight test path
START = (-34.619, -58.463)
SPAN = (0.015, 0.082)
N_VERTICES = 12
NOW = 17_067_000
LINES = ["26", "39", "42", "151"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GPS-like row per event; event time compressed 100 times."""
    return pings_from(table(spark, sf_dir, "events"))


def pings_from(events: DataFrame) -> DataFrame:
    raw = events.select("event_id", "user_id", "value", F.col("ts").alias("raw_ts"))
    e = raw.withColumn("raw_epoch", F.expr("unix_micros(cast(raw_ts as timestamp)) div 1000000"))
    e = e.withColumn("ts", F.expr("raw_epoch div 100"))
    phase = (F.col("ts") % 3000) / F.lit(3000.0)
    wobble = F.lit(0.0004) * (F.col("event_id") % 9 - 4).cast("double")
    return e.select(
        F.col("user_id").cast("string").alias("vehicle_id"),
        "event_id",
        "raw_epoch",
        "ts",
        (F.col("ts") - F.col("ts") % 30).alias("frame_ts"),
        (F.lit(START[0]) + F.lit(SPAN[0]) * phase + wobble).alias("lat"),
        (F.lit(START[1]) + F.lit(SPAN[1]) * phase).alias("lon"),
        (F.col("value") % 15).alias("speed"),
        (F.col("user_id") % 2).cast("int").alias("direction_id"),
        (F.col("user_id") % 12 + 1300).cast("string").alias("route_id"),
        F.concat_ws("-", F.col("user_id"), F.col("user_id") % 5).alias("label"),
        F.when(F.expr("day(cast(raw_ts as date)) <= 15"), "20240101").otherwise("20240116").alias("start_date"),
        F.lit("08:00:00").alias("start_time"),
        F.date_format(F.to_date("raw_ts"), "yyyy-MM-dd").alias("day"),
    )


def _path(offset: float, share: float, backward: bool) -> list[list[float]]:
    pts = [
        [round(START[0] + SPAN[0] * share * i / (N_VERTICES - 1) + offset, 7), round(START[1] + SPAN[1] * share * i / (N_VERTICES - 1), 7)]
        for i in range(N_VERTICES)
    ]
    return pts[::-1] if backward else pts


def _stops(points: list[list[float]], shape_id: str) -> list[dict]:
    # a stop at every third vertex; the second one has no name
    return [
        {"id": f"n{shape_id}{i}", "name": "" if i == 3 else f"Stop {i}", "lat": p[0], "lng": p[1]}
        for i, p in enumerate(points)
        if i % 3 == 0
    ]


def shapes_json() -> dict:
    """Line 39: A, B (100 m aside), D (first 40 % of A), both ways; one two-way branch on the others."""
    out: dict[str, dict] = {}

    def add(line: str, short: str, ident: str, offset: float, share: float) -> None:
        body = out.setdefault(line, {"color": f"#C{line}FF", "ramales": []})
        for d in (0, 1):
            pts = _path(offset, share, d == 1)
            body["ramales"].append(
                {
                    "name": f"Line {line} - {short}: {'South → North' if d == 0 else 'North → South'}",
                    "shortName": short,
                    "shapeId": f"{ident}{d}",
                    "direction": d,
                    "points": pts,
                    "stops": _stops(pts, f"{ident}{d}"),
                }
            )

    add("39", "39A", "39a", 0.0, 1.0)
    add("39", "39B", "39b", 0.0009, 1.0)
    add("39", "39D", "39d", 0.0, 0.4)
    add("42", "42A", "42a", 0.0003, 1.0)
    add("26", "26A", "26a", -0.0003, 1.0)
    add("151", "151A", "151a", 0.0, 0.9)
    return out


LABEL_MAP = {"0": ("39", "Agency South"), "1": ("42", "Agency West"), "2": ("26", "Agency North"), "3": (None, ""), "4": ("151", "Agency South")}
FAMILIES = {"39A": ["39D"]}
# route id → shape stem; 1310 and 1311 stay unresolved
ROUTE_SHAPES = {1300: "39a", 1301: "39a", 1302: "39a", 1303: "39b", 1304: "39b", 1305: "39b", 1306: "39d", 1307: "39d", 1308: "42a", 1309: "42a"}


def _doc(spark: SparkSession, value: dict) -> DataFrame:
    return spark.range(1).select(F.lit(json.dumps(value, ensure_ascii=False)).alias("text"))


_PLANS: dict[tuple[int, str], DataFrame] = {}


def _once(spark: SparkSession, name: str, build) -> DataFrame:
    """Reuse the (lazy) plan of a dimension inside one session; no data is kept."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def shapes(spark: SparkSession) -> DataFrame:
    return _once(spark, "shapes", lambda: shape_source.parse_shapes(_doc(spark, shapes_json())))


def paths(spark: SparkSession) -> DataFrame:
    return _once(spark, "paths", lambda: prepared_paths(shapes(spark)))


def label_map(spark: SparkSession) -> DataFrame:
    return _once(spark, "label_map", lambda: shape_source.parse_label_map(label_map_doc(spark)))


def label_map_doc(spark: SparkSession) -> DataFrame:
    return _doc(spark, {"map": {s: {"line": line, "agencyName": a} for s, (line, a) in LABEL_MAP.items()}})


def branch_map_json() -> dict:
    entries = [
        {"route_id": str(r), "direction_id": r % 2, "shape_id": f"{stem}{r % 2}", "status": "active", "assignment_status": "resolved"}
        for r, stem in ROUTE_SHAPES.items()
    ]
    entries += [{"route_id": str(r), "direction_id": r % 2, "shape_id": None, "status": "active", "assignment_status": "pending"} for r in (1310, 1311)]
    return {"lines": {"39": {"entries": entries}}}


def branch_map(spark: SparkSession) -> DataFrame:
    return _once(spark, "branch_map", lambda: shape_source.parse_branch_map(_doc(spark, branch_map_json())))


def families(spark: SparkSession) -> DataFrame:
    doc = {"line": "39", "description": "test", "families": FAMILIES}
    return _once(spark, "families", lambda: shape_source.parse_families(_doc(spark, doc)))


def lined_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_line(pings(spark, sf_dir), label_map(spark))


def trip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings with their line, cut in trips."""
    return segment_trips(lined_pings(spark, sf_dir))


_STAGES: dict[tuple[str, str, str], str] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An intermediate table of the application, written once to shared storage and read by later jobs."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _STAGES:
        try:
            return spark.read.parquet(_STAGES[key])
        except AnalysisException:
            pass
    path = shared_dir(spark, name)
    build().write.parquet(path)
    _STAGES[key] = path
    return spark.read.parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def projected_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected trip points near their shape."""
    return stage(spark, sf_dir, "projected", lambda: on_assigned_shape(spark, trip_points_table(spark, sf_dir)))


def trip_points_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip points of all lines."""
    return stage(spark, sf_dir, "trip_points", lambda: trip_points(spark, sf_dir))


def on_assigned_shape(spark: SparkSession, points: DataFrame, near: bool = True) -> DataFrame:
    p = paths(spark)
    project = project_near if near else project_points
    return project(assign_shape(points, branch_map(spark), p), p, ["shape_id"])


def projected(spark: SparkSession, sf_dir: str, near: bool = True) -> DataFrame:
    """Trip points on their assigned shape; by default only those within the limit."""
    return on_assigned_shape(spark, trip_points(spark, sf_dir), near)
