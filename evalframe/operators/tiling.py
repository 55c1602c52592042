"""Patch grids, manifests, and pixels by patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.exprs import normalize, patch_grid
from evalframe.operators.stats import STATS, band_stats

MANIFEST = ("patch_id", "sample_id", "dataset", "split", "patch_index", "row_off", "col_off", "height", "width", "image_height", "image_width", "patch_size", "overlap", "version")


def split_lookup(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Each sample's split; one that is not known is in train."""
    return samples.join(splits.select("sample_id", "split"), "sample_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def patch_manifest(samples: DataFrame, sizes: DataFrame, splits: DataFrame, patch: int, overlap: int = 0, version: str = "1") -> DataFrame:
    """A row for each window of each sample with a size, numbered row by row."""
    rows = split_lookup(samples.select("sample_id", "dataset").join(sizes, "sample_id"), splits)
    grid = F.posexplode(patch_grid(F.col("image_height"), F.col("image_width"), patch, overlap)).alias("patch_index", "w")
    rows = rows.withColumnsRenamed({"height": "image_height", "width": "image_width"}).select("*", grid)
    rows = rows.select("*", "w.*").withColumns({"patch_size": F.lit(patch), "overlap": F.lit(overlap), "version": F.lit(version), "patch_id": F.concat_ws("_", "sample_id", "patch_index")})
    return rows.select(*MANIFEST)


def grid_metadata(patches: DataFrame) -> DataFrame:
    """One row for each sample: its windows in order, and whether any overlap."""
    w = F.array_sort(F.collect_list(F.struct("patch_index", "row_off", "col_off", "height", "width")))
    out = patches.groupBy("sample_id").agg(w.alias("windows"), F.max("overlap").alias("overlap"))
    return out.withColumn("has_overlap", F.col("overlap") > 0).drop("overlap")


def containing(position: Column, length: Column, patch: int, overlap: int) -> Column:
    """Offsets of all windows of an axis that hold a position: at most a few, computed without a range join."""
    from evalframe.functions.exprs import axis_offsets

    return F.filter(axis_offsets(length, patch, patch - overlap), lambda o: (o <= position) & (position < o + patch))


def pixels_by_patch(pixels: DataFrame, patch: int, overlap: int = 0) -> DataFrame:
    """Every pixel once for each window that holds it, with the window's offsets. ``height`` and ``width`` are the image's."""
    rows = pixels.withColumn("row_off", F.explode(containing(F.col("row_px"), F.col("height"), patch, overlap)))
    return rows.withColumn("col_off", F.explode(containing(F.col("col_px"), F.col("width"), patch, overlap)))


def normalize_patches(pixels: DataFrame, bands: list[str], mode: str, patch: int, overlap: int = 0) -> DataFrame:
    """Pixels by patch, each normalized with its own patch's statistics."""
    keys = ["sample_id", "row_off", "col_off"]
    tiles = pixels_by_patch(pixels, patch, overlap)
    stats = band_stats(tiles, bands, keys).groupBy(*keys).agg(*[F.max(F.when(F.col("band") == i, F.col(s))).alias(f"{b}_{s}") for i, b in enumerate(bands) for s in STATS])
    out = tiles.join(stats, keys)
    return out.select(*[c for c in tiles.columns if c not in bands], *[normalize(F.col(b), mode, {s: F.col(f"{b}_{s}") for s in STATS}).alias(b) for b in bands])
