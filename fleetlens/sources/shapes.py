"""Readers of route geometry and of the label, branch and family maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators.scale import number_rows


def _document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def parse_shapes(docs: DataFrame, lines: list[str] | None = None) -> DataFrame:
    """One row per branch: line, color, branch_pos, shape_id, short_name, name, direction, points, stops."""
    by_line = docs.select(F.explode(F.from_json("text", schemas.SHAPES_JSON)).alias("line", "body"))
    if lines is not None:
        by_line = by_line.where(F.col("line").isin(lines))
    branches = by_line.select("line", F.col("body.color").alias("color"), F.posexplode("body.ramales").alias("branch_pos", "b"))
    as_point = lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon"))
    return branches.select(
        "line",
        "color",
        "branch_pos",
        F.coalesce(_filled(F.col("b.shapeId")), F.concat_ws("-", "line", F.coalesce(F.col("b.direction"), F.lit(0)).cast("string"))).alias("shape_id"),
        F.coalesce(F.col("b.shortName"), F.col("line")).alias("short_name"),
        F.coalesce(F.col("b.name"), F.lit("")).alias("name"),
        F.col("b.direction").alias("direction"),
        F.transform("b.points", as_point).alias("points"),
        F.col("b.stops").alias("stops"),
    )


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def read_shapes(spark: SparkSession, path: str, lines: list[str] | None = None) -> DataFrame:
    return parse_shapes(_document(spark, path), lines)


def parse_label_map(docs: DataFrame, unique_only: bool = True) -> DataFrame:
    """suffix, line, agency. Entries of several lines carry no line and are skipped."""
    rows = docs.select(F.explode(F.from_json("text", schemas.LABEL_MAP_JSON)["map"]).alias("suffix", "e")).select(
        "suffix", _filled(F.col("e.line")).alias("line"), F.coalesce(F.col("e.agencyName"), F.lit("")).alias("agency")
    )
    return rows.where(F.col("line").isNotNull()) if unique_only else rows


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_label_map(_document(spark, path))


def label_map_from_shapes(shapes: DataFrame) -> DataFrame:
    """Fallback map: every line and short name points to its line; the later entry wins."""
    own = shapes.select(F.col("line").alias("suffix"), "line", F.lit(-1).alias("pos"))
    short = shapes.select(F.col("short_name").alias("suffix"), "line", F.col("branch_pos").alias("pos"))
    return own.unionByName(short).groupBy("suffix").agg(F.max_by("line", F.struct("line", "pos")).alias("line"))


def parse_branch_map(docs: DataFrame) -> DataFrame:
    """One row per (route_id, direction_id) with a shape; incomplete entries are dropped."""
    entries = docs.select(F.explode(F.from_json("text", schemas.BRANCH_MAP_JSON)["lines"]).alias("line", "body"))
    return (
        entries.select("line", F.explode("body.entries").alias("e"))
        .select("line", "e.*")
        .where("route_id is not null and direction_id is not null and coalesce(shape_id, '') <> ''")
    )


def read_branch_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_branch_map(_document(spark, path))


def parse_families(docs: DataFrame) -> DataFrame:
    """line, parent, child."""
    doc = docs.select(F.from_json("text", schemas.FAMILIES_JSON).alias("f"))
    return doc.select("f.line", F.explode("f.families").alias("parent", "children")).select(
        "line", "parent", F.explode("children").alias("child")
    )


def read_families(spark: SparkSession, path: str) -> DataFrame:
    return parse_families(_document(spark, path))


def available_lines(shapes: DataFrame) -> DataFrame:
    return shapes.select("line").distinct().orderBy("line")


def shapes_document(shapes: DataFrame, per_document: int = 64) -> DataFrame:
    """Inverse of ``parse_shapes``: JSON texts of one line each, of at most ``per_document`` of its branches.

    A line of more branches has several documents; a branch's place is then counted in its own.
    """
    sliced = shapes.withColumn("_slice", F.pmod(F.xxhash64("shape_id"), F.lit(256)))
    shapes = number_rows(sliced, ["line"], "_slice", ["branch_pos", "shape_id"], "_no").withColumn("_doc", F.floor(F.col("_no") / per_document))
    branch = F.struct(
        "branch_pos",
        F.col("name"),
        F.col("short_name").alias("shortName"),
        F.col("shape_id").alias("shapeId"),
        F.col("direction"),
        F.transform("points", lambda p: F.array(p["lat"], p["lon"])).alias("points"),
        F.col("stops"),
    )
    drop_pos = lambda b: F.struct(b["name"], b["shortName"], b["shapeId"], b["direction"], b["points"], b["stops"])
    return (
        shapes.groupBy("line", "_doc")
        .agg(F.first("color").alias("color"), F.array_sort(F.collect_list(branch)).alias("ramales"))
        .select(
            "line",
            F.to_json(
                F.map_from_arrays(F.array("line"), F.array(F.struct("color", F.transform("ramales", drop_pos).alias("ramales"))))
            ).alias("text"),
        )
    )


def write_documents(docs: DataFrame, path: str) -> None:
    """A file per JSON text, as the readers of this module expect."""
    docs.select(F.col("text").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
