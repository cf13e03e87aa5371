"""Documents written as files and read back."""

from pyspark.sql import functions as F

from fleetlens.sources import shapes as ss


def test_a_line_of_many_branches_has_several_documents(spark, tmp_path):
    point = F.struct(F.col("id").cast("double").alias("lat"), F.lit(-58.4).alias("lon"))
    stop = F.struct(F.lit("a").alias("id"), F.lit("A").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"))
    line = F.when(F.col("id") < 40, "hot").otherwise("cold")
    shapes = spark.range(43).select(
        line.alias("line"), F.lit("#fff").alias("color"), F.col("id").cast("int").alias("branch_pos"), F.concat(F.lit("s"), "id").alias("shape_id"),
        F.lit("x").alias("short_name"), F.lit("n").alias("name"), F.lit(1).alias("direction"), F.array(point, point).alias("points"), F.array(stop).alias("stops"),
    )
    docs = ss.shapes_document(shapes, per_document=7)
    assert sorted(r["line"] for r in docs.collect()) == ["cold"] + ["hot"] * 6
    path = str(tmp_path / "docs")
    ss.write_documents(docs, path)
    key = lambda df: sorted((r["line"], r["shape_id"], r["points"][0]["lat"], len(r["points"]), r["stops"][0]["lng"]) for r in df.collect())
    assert key(ss.read_shapes(spark, path)) == key(shapes)
    assert key(ss.read_shapes(spark, path, ["cold"])) == key(shapes.where("line = 'cold'"))
    assert max(r["branch_pos"] for r in ss.read_shapes(spark, path).collect()) == 6
