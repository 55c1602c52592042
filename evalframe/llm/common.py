"""Session helpers of the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; without one there is none to write to."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = found.get()
    return at


def cut(df: DataFrame) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it from there, so that later steps neither repeat nor depend on what made it."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes written tables that nothing reads any more, and empties the list."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to be added, which no column of the DataFrame has."""
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def with_few(rows: DataFrame, few: DataFrame, key: str | list[str], how: str = "inner", limit: int = 20_000) -> DataFrame:
    """Joins rows to a written table of one row for each key: broadcast if it has at most ``limit`` rows, else as Spark sees fit."""
    return rows.join(F.broadcast(few) if few.limit(limit + 1).count() <= limit else few, key, how)
