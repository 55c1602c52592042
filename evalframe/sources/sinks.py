"""Writers of manifests, splits, logs, reports and checksums, and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalframe.sources.files import write_tree


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header and columns in the given order."""
    df.select(*(columns or df.columns)).write.mode(mode).option("header", True).csv(path)


def write_files(df: DataFrame, path: str) -> None:
    """A text file for each row: ``value`` and a line's end, in ``folder``, under ``name``."""
    write_tree(df.withColumn("value", F.concat("value", F.lit("\n"))), path)


def write_splits(splits: DataFrame, path: str) -> None:
    """Parquet by split, so that a reader of one split reads only its files, and JSON."""
    splits.write.partitionBy("split").parquet(f"{path}/parquet")
    splits.write.json(f"{path}/json")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each section as JSON, and all as one CSV."""
    from evalframe.operators.compare import sections

    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
    write_csv(sections(**tables), f"{path}/report_csv")


def append_log(df: DataFrame, path: str, columns: list[str]) -> None:
    """Appends records as JSON lines and CSV with fixed columns: others are dropped, missing ones are empty."""
    known = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    fixed = df.select(*known)
    fixed.write.mode("append").option("ignoreNullFields", False).json(f"{path}/jsonl")
    fixed.write.mode("append").option("header", True).csv(f"{path}/csv")


def write_checksums(files: DataFrame, path: str) -> None:
    """Lines of checksum and path, by path."""
    files.orderBy("path").select(F.concat_ws("  ", "checksum", "path").alias("value")).write.text(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str, form: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(form).option("header", True).load(path)


def write_tables(tables: dict[str, DataFrame], path: str, version: str) -> None:
    """One Parquet table for each output of a prepared dataset, under a versioned folder."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
