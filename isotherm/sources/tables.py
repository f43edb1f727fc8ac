"""Tables that a computation writes on its way: in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master gets a local folder and any other is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "isotherm-tables")
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write and read again. What comes after survives lost executors."""
    path, schema = path or new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def emptied(spark: SparkSession, path: str) -> None:
    """Free the space of a table that nothing reads any more."""
    spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)


class Steps:
    """Tables that follow each other, each made from the one before: when one is written, the one before is freed.

    All lie in a folder of their own; free() gives the space of the last one back as well.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_path(spark, name), 0

    def next(self, df: DataFrame) -> DataFrame:
        before, self.n = self.n, self.n + 1
        out = written(df, "", f"{self.folder}/{self.n}")
        if before:
            emptied(self.spark, f"{self.folder}/{before}")
        return out

    def free(self) -> None:
        if self.n:
            emptied(self.spark, self.folder)
