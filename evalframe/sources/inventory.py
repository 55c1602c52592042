"""Scans of files, provenance manifests, and raster metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions import exprs as X
from evalframe.functions.vocab import EXTENSIONS, REQUIRED_FIELDS
from evalframe.sources.files import scan_tree

SAMPLES = "sample_id string, image_path string, label_path string"
IGNORED = ("README.md", ".gitkeep")


def scan_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, length[, content]) of all files under a root by Spark's own reader, for stores that only it can open.

    Paths are absolute. Content is read only if asked for. A root that does not exist has no files.
    """
    columns = ["path", "length", *(["content"] if content else [])]
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        kinds = {"path": "string", "length": "long", "content": "binary"}
        return spark.createDataFrame([], ", ".join(f"{c} {kinds[c]}" for c in columns))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(*columns)


def scan_folders(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, length[, content]) of all files under a root, paths relative to it, by the ``filetree`` source."""
    return scan_tree(spark, root, "content" if content else "list")


META = "path string, height int, width int, count int, dtype string, crs string, transform array<double>, nodata double"
_META = [part.split()[0] for part in META.split(", ")]


def read_meta(files: DataFrame, reader: Callable[[str, bytes], dict]) -> DataFrame:
    """Raster metadata of files with ``content`` by the user's reader, which gets a path and bytes and gives a dict.

    A file at which the reader fails has nulls besides its path, which validation reports as corrupted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, raw in zip(df["path"], df["content"]):
                try:
                    got = dict(reader(path, bytes(raw)))
                except Exception:  # noqa: BLE001 - whatever the reader cannot read
                    got = {}
                rows.append([path, *(got.get(c) for c in _META[1:])])
            yield pd.DataFrame(rows, columns=_META).astype({"height": "Int32", "width": "Int32", "count": "Int32", "nodata": "Float64"})

    return files.select("path", "content").mapInPandas(run, META)


def read_labels(files: DataFrame, reader: Callable[[str, bytes], np.ndarray]) -> DataFrame:
    """(path, label, pixels): the classes of each label file and how often they occur, by the user's reader of class arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, raw in zip(df["path"], df["content"]):
                label, n = np.unique(np.asarray(reader(path, bytes(raw))), return_counts=True)
                yield pd.DataFrame({"path": path, "label": label.astype("int32"), "pixels": n.astype("int64")})

    return files.select("path", "content").mapInPandas(run, "path string, label int, pixels long")


def read_bands(files: DataFrame, reader: Callable[[str, bytes], np.ndarray]) -> DataFrame:
    """(path, row_px, col_px, bands): every pixel of image files, by the user's reader of arrays (band, row, column)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, raw in zip(df["path"], df["content"]):
                x = np.asarray(reader(path, bytes(raw)), float)
                row, col = np.divmod(np.arange(x.shape[1] * x.shape[2]), x.shape[2])
                yield pd.DataFrame({"path": path, "row_px": row, "col_px": col, "bands": list(x.reshape(len(x), -1).T)})

    return files.select("path", "content").mapInPandas(run, "path string, row_px long, col_px long, bands array<double>")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def discover_pairs(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """images/<id>.<ext> of supported types, with labels/<id>.tif where it exists."""
    images = files.where(F.col("path").rlike("(^|/)images/[^/]+$") & X.supported_type(F.col("path"), extensions))
    labels = files.where(F.col("path").rlike(r"(^|/)labels/[^/]+\.tif$")).select(file_stem(F.col("path")).alias("sample_id"), F.col("path").alias("label_path"))
    return images.select(file_stem(F.col("path")).alias("sample_id"), F.col("path").alias("image_path")).join(labels, "sample_id", "left")


def discover_band_dirs(dirs: DataFrame, bands: list[str], labels: DataFrame | None = None) -> DataFrame:
    """For each sample's folder all expected band files, whether they exist or not, in band order; the label if it exists."""
    paths = F.array(*[F.concat_ws("/", "dir", F.lit(b + ".tif")) for b in bands])
    out = dirs.select(file_stem(F.col("dir")).alias("sample_id"), paths.alias("image_paths"))
    return out.withColumn("label_path", F.lit(None).cast("string")) if labels is None else out.join(labels.select("sample_id", "label_path"), "sample_id", "left")


def discover(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Pairs under a root, and one status row; a root without files gives no rows and a message, not an error."""
    own = files.where(F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")))
    pairs = discover_pairs(own)
    status = own.agg(F.count("*").alias("files")).select(F.lit(root).alias("root"), "files", F.when(F.col("files") == 0, "dataset root has no files").otherwise("ok").alias("message"))
    return pairs, status


def discover_root(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Scans a root, which need not exist, and discovers the pairs under it; paths and status have ``name`` for the root."""
    files = scan_tree(spark, root).withColumn("path", F.concat_ws("/", F.lit(name.rstrip("/")), "path"))
    return discover(files, name)


def directory_summary(files: DataFrame, keys: list[str], ignore: tuple[str, ...] = IGNORED) -> DataFrame:
    """Number and bytes of files, scaffolding files left out."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.where(~name.isin(*ignore)).groupBy(*keys).agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def checksums(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    raw = F.col("content").cast("binary")
    digest = {"sha256": F.sha2(raw, 256), "md5": F.md5(raw), "sha1": F.sha1(raw)}
    if algorithm not in digest:
        raise ValueError(f"unsupported algorithm: {algorithm}")
    return files.withColumn("checksum", digest[algorithm])


def manifest_violations(entries: DataFrame, key: str, required: tuple[str, ...] = REQUIRED_FIELDS) -> DataFrame:
    """(key, field) of every required field that an entry lacks, absent columns included."""
    have = set(entries.columns)
    fields = F.array(*[F.when(F.col(f).isNull() if f in have else F.lit(True), F.lit(f)) for f in required])
    return entries.select(key, F.explode(F.array_compact(fields)).alias("field"))


def load_manifest(entries: DataFrame, key: str, required: tuple[str, ...] = REQUIRED_FIELDS, listed: str = "manual_steps") -> DataFrame:
    """Entries that have all required fields; a single step becomes a list."""
    have = set(entries.columns)
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() if f in have else F.lit(False) for f in required])
    out = entries.where(whole)
    if listed in have and not entries.schema[listed].dataType.simpleString().startswith("array"):
        out = out.withColumn(listed, F.array(listed))
    return out


def raster_meta(table: DataFrame) -> DataFrame:
    """(path, height, width, count, dtype, crs, transform, nodata) with types as declared; decoding is the user's."""
    kinds = {"path": "string", "height": "int", "width": "int", "count": "int", "dtype": "string", "crs": "string", "transform": "array<double>", "nodata": "double"}
    return table.select(*[(F.col(c) if c in table.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def missing_files(expected: DataFrame, files: DataFrame) -> DataFrame:
    return expected.join(files.select("path").distinct(), "path", "left_anti")


def checksum_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that exist, have an expected checksum, and differ from it."""
    e = expected.where(F.coalesce(F.trim("expected"), F.lit("")) != "").select("path", "expected")
    return files.join(e, "path").where(~X.checksum_matches(F.col("checksum"), F.col("expected")))


def acquisition_plan(entries: DataFrame) -> DataFrame:
    """For each dataset: manual access with its steps, or each url with the file name that it gets."""
    url = F.explode_outer("urls").alias("url")
    rows = entries.select("dataset_id", "steps", F.when(F.size("urls") > 0, F.col("urls")).alias("urls")).select("dataset_id", "steps", url)
    status = F.when(F.col("url").isNull(), "manual_access_required").otherwise("planned")
    return rows.select("dataset_id", status.alias("status"), "url", F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1).alias("filename"), F.when(F.col("url").isNull(), F.col("steps")).alias("steps"))
