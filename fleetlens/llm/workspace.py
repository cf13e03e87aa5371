"""Intermediate tables of one operator run."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import shared_dir


class Workspace:
    """Tables written under the folder that the cluster names in ``spark.checkpoint.dir``.

    Every table is written once and read back, so a lost executor costs the
    current step only. Spark drops the shuffle files of a finished step when the
    driver's JVM collects its plan; ``store`` asks for that, so that an operator
    of many steps holds the shuffles of one.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, shared_dir(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        del df
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
