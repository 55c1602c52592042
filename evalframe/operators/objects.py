"""Objects of class masks: connected components over tiles, and failures by edge and size.

Masks are cut into tiles, each with a ring of its neighbours' pixels, so that a task
holds one tile whatever the size of an image. In a tile, runs of equal classes are
labelled in numpy. A pixel of a ring has a label in its own tile and one in the
neighbour's: these pairs are the edges of a small graph of labels whose components
are the objects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.operators.graph import connected_components
from evalframe.sources.shared import checkpointed

#: Side of a tile in pixels.
TILE = 256
#: Objects of at most so many pixels are small; one of which at least this share is wrong has failed.
SMALL_PIXELS, FAILED_SHARE = 16, 0.5
_EIGHT, _FOUR = ((0, 1), (1, -1), (1, 0), (1, 1)), ((0, 1), (1, 0))


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is linked with, by hooking roots and halving paths."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if not (left := low != high).any():
            break
        a, b = a[left], b[left]
        np.minimum.at(root, high[left], low[left])
        while (root != (up := root[root])).any():
            root = up
    return root


def _shifted(grid: np.ndarray, dr: int, dc: int, fill: int) -> np.ndarray:
    """The grid's value at (row + dr, column + dc) for each cell."""
    out = np.full_like(grid, fill)
    h, w = grid.shape
    if abs(dr) < h and abs(dc) < w:
        out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = grid[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def near_other(grid: np.ndarray, width: int, absent: int) -> np.ndarray:
    """Whether a cell of another class is at most ``width`` rows and columns away; absent cells are of no class."""
    least, most = np.where(grid == absent, np.iinfo(np.int64).max, grid), np.where(grid == absent, np.iinfo(np.int64).min, grid)
    for step in ((1, 0), (0, 1)):
        low, high = least.copy(), most.copy()
        for k in range(1, width + 1):
            for sign in (-k, k):
                low = np.minimum(low, _shifted(least, step[0] * sign, step[1] * sign, np.iinfo(np.int64).max))
                high = np.maximum(high, _shifted(most, step[0] * sign, step[1] * sign, np.iinfo(np.int64).min))
        least, most = low, high
    return (grid != absent) & ((least != grid) | (most != grid))


def _label_tile(connectivity: int, width: int):
    links = {4: _FOUR, 8: _EIGHT}[connectivity]
    absent = np.iinfo(np.int64).min

    def run(tile: pa.Table) -> pa.Table:
        row, col, cls = (tile[c].to_numpy().astype(np.int64) for c in ("row_px", "col_px", "class_index"))
        r, c = row - row.min(), col - col.min()
        grid = np.full((int(r.max()) + 1, int(c.max()) + 1), absent)
        grid[r, c] = cls
        cell = np.arange(grid.size).reshape(grid.shape)  # by row and column, so that the least cell is the first of its object
        a, b = [], []
        for dr, dc in links:
            same = (grid != absent) & (grid == _shifted(grid, dr, dc, absent))
            at = np.flatnonzero(same)
            a.append(at)
            b.append(at + dr * grid.shape[1] + dc)
        first = components_of(grid.size, np.concatenate(a), np.concatenate(b))[cell[r, c]]
        edge = near_other(grid, width, absent)[r, c]
        for name, x in (("object_row", first // grid.shape[1] + row.min()), ("object_col", first % grid.shape[1] + col.min()), ("at_edge", edge)):
            tile = tile.append_column(name, pa.array(x))
        return tile

    return run


def label_objects(mask: DataFrame, key: str = "image_id", connectivity: int = 8, width: int = 1, tile: int = TILE) -> DataFrame:
    """The mask's pixels with the object that each is in and whether it is near an edge of its class.

    ``mask``: the key, ``row_px``, ``col_px``, ``class_index``, one row for each pixel; other columns are left out. An
    object is a connected part of one class in one image, named by its first pixel (``object_row``, ``object_col``) by rows
    and columns. ``at_edge``: a pixel of another class is at most ``width`` rows and columns away. Cells without a pixel
    are of no class. Pixels whose key, place or class is null go.
    """
    pixels = mask.select(F.col(key).alias("key"), *[F.col(c).cast("long").alias(c) for c in ("row_px", "col_px", "class_index")]).dropna()
    ring = max(width, 1)
    # a pixel belongs to its own tile and, in their rings, to those that are at most ``ring`` away
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (-ring, 0, ring)]))
    own = (F.col("tile_row") == F.floor(F.col("row_px") / tile)) & (F.col("tile_col") == F.floor(F.col("col_px") / tile))
    dealt = pixels.withColumn("tile_row", F.explode(near("row_px"))).withColumn("tile_col", F.explode(near("col_px"))).withColumn("own", own)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", object_row long, object_col long, at_edge boolean"
    labelled = checkpointed(dealt.groupBy("key", "tile_row", "tile_col").applyInArrow(_label_tile(connectivity, width), schema).drop("tile_row", "tile_col"))
    node = F.struct("key", "object_row", "object_col")
    mine, theirs = labelled.where("own"), labelled.where("not own").select("key", "row_px", "col_px", node.alias("a")).distinct()
    edges = theirs.join(mine.select("key", "row_px", "col_px", node.alias("b")), ["key", "row_px", "col_px"]).select("a", "b").distinct()
    known = connected_components(edges).withColumnRenamed("node", "label")
    out = mine.withColumn("label", node).join(known, "label", "left").withColumn("object", F.coalesce("component", "label"))
    return out.select(F.col("key").alias(key), "row_px", "col_px", F.col("class_index").cast("int").alias("class_index"), F.col("object.object_row").alias("object_row"), F.col("object.object_col").alias("object_col"), "at_edge")


def object_table(labelled: DataFrame, wrong: DataFrame, key: str = "image_id") -> DataFrame:
    """One row for each object: pixels, of these wrong and near an edge, and its bounds. ``wrong``: key, row_px, col_px and ``wrong`` of every pixel."""
    rows = labelled.join(wrong.select(key, "row_px", "col_px", "wrong"), [key, "row_px", "col_px"])
    sides = [f(F.col(c)).alias(f"{n}_{c[:3]}") for n, f in (("first", F.min), ("last", F.max)) for c in ("row_px", "col_px")]
    return rows.groupBy(key, "object_row", "object_col", "class_index").agg(F.count("*").alias("pixels"), F.count_if("wrong").alias("wrong_pixels"), F.count_if("at_edge").alias("edge_pixels"), F.count_if(F.col("wrong") & F.col("at_edge")).alias("edge_errors"), *sides)


def spatial_failures(objects: DataFrame, key: str = "image_id", background: tuple[int, ...] = (0,), small: int = SMALL_PIXELS, share: float = FAILED_SHARE) -> DataFrame:
    """For each image: wrong pixels in all and near edges, small objects and those that failed, and the categories that hold."""
    is_small = ~F.col("class_index").isin(*background) & (F.col("pixels") <= small)
    failed = is_small & (F.col("wrong_pixels") >= share * F.col("pixels"))
    sums = objects.groupBy(key).agg(F.sum("wrong_pixels").alias("errors"), F.sum("edge_errors").alias("edge_errors"), F.count_if(is_small).alias("small_objects"), F.count_if(failed).alias("small_failures"))
    held = F.array_compact(F.array(F.when(F.col("edge_errors") > 0, "edge_error"), F.when(F.col("small_failures") > 0, "small_object_failure")))
    return sums.withColumn("categories", held)
