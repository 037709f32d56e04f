"""Intermediates of a job with many rounds, kept in the shared folder only as long as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fedtab.functions.common import new_path


class Stages:
    """Named intermediates. A new one under a name replaces the former one, which is removed once the new one stands; what
    is computed from a former one must therefore be written before the name is used again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "stage")
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
