"""Augmentations of pixel tables: coordinates and values change by a coin for each patch and operation.

A table has ``sample_id``, ``row_px``, ``col_px``, band columns, and the patch's ``height`` and ``width``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.functions.exprs import coin
from evalframe.functions.vocab import SEED


def _on(op: str, p: float, seed: int):
    return coin(seed, F.col("sample_id"), op) < p


def flip(df: DataFrame, horizontal: bool = True, vertical: bool = False, p: float = 0.5, seed: int = SEED) -> DataFrame:
    on, out = _on("flip", p, seed), {}
    if horizontal:
        out["col_px"] = F.when(on, F.col("width") - 1 - F.col("col_px")).otherwise(F.col("col_px"))
    if vertical:
        out["row_px"] = F.when(on, F.col("height") - 1 - F.col("row_px")).otherwise(F.col("row_px"))
    return df.withColumns(out)


def rotate(df: DataFrame, quarters: int = 1, p: float = 0.5, seed: int = SEED) -> DataFrame:
    """Quarter turns against the clock, which move pixels only; ``rotate_by`` turns by any angle."""
    on = _on("rotate", p, seed)
    for _ in range(quarters % 4):
        r, c, h, w = (F.col(x) for x in ("row_px", "col_px", "height", "width"))
        df = df.withColumns({"row_px": F.when(on, w - 1 - c).otherwise(r), "col_px": F.when(on, r).otherwise(c), "height": F.when(on, w).otherwise(h), "width": F.when(on, h).otherwise(w)})
    return df


def rotate_by(df: DataFrame, bands: tuple[str, ...] = (), labels: tuple[str, ...] = (), limit: float = 90.0, angle: float | None = None, p: float = 0.5, seed: int = SEED) -> DataFrame:
    """Turns patches about their centre against the clock, by ``angle`` degrees or by one within +-``limit`` that the patch's hash gives.

    Patches keep their size; what leaves it goes. Bands are interpolated between the four pixels around the place that a
    target comes from, by the weights of those that are there and not null; labels come from the nearest pixel, and are
    null if that is missing. A target that no pixel is near has no row. Pixels at one place count together; of their
    labels the least stands. Columns besides the bands and labels go.

    Each pixel meets only the targets around the place that it is turned to, so that one grouping by target does it.
    """
    turn = (coin(seed, F.col("sample_id"), "rotate_by") * 2 - 1) * limit if angle is None else F.lit(float(angle))
    theta = F.radians(F.when(_on("rotate", p, seed), turn).otherwise(0.0))
    r, c = F.col("row_px") - (F.col("height") - 1) / 2, F.col("col_px") - (F.col("width") - 1) / 2
    rows = df.withColumns({"_cos": F.cos(theta), "_sin": F.sin(theta), "_r": r, "_c": c})
    at = {"_tr": F.col("_cos") * F.col("_r") - F.col("_sin") * F.col("_c") + (F.col("height") - 1) / 2, "_tc": F.col("_sin") * F.col("_r") + F.col("_cos") * F.col("_c") + (F.col("width") - 1) / 2}
    rows = rows.withColumns(at)
    near = lambda n: F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda d: (F.floor(F.col(n)) + d).cast("int"))
    rows = rows.withColumn("_row", F.explode(near("_tr"))).withColumn("_col", F.explode(near("_tc")))
    rows = rows.where((F.col("_row") >= 0) & (F.col("_row") < F.col("height")) & (F.col("_col") >= 0) & (F.col("_col") < F.col("width")))
    # where the target comes from, from this pixel
    tr, tc = F.col("_row") - (F.col("height") - 1) / 2, F.col("_col") - (F.col("width") - 1) / 2
    rows = rows.withColumns({"_dr": F.round(F.col("_cos") * tr + F.col("_sin") * tc - F.col("_r"), 12), "_dc": F.round(F.col("_cos") * tc - F.col("_sin") * tr - F.col("_c"), 12)})
    rows = rows.withColumn("_w", (1 - F.abs("_dr")) * (1 - F.abs("_dc"))).where((F.abs("_dr") < 1) & (F.abs("_dc") < 1) & (F.col("_w") > 1e-9))
    nearest = (F.col("_dr") >= -0.5) & (F.col("_dr") < 0.5) & (F.col("_dc") >= -0.5) & (F.col("_dc") < 0.5)
    values = [F.try_divide(F.sum(F.col("_w") * F.col(b)), F.sum(F.when(F.col(b).isNotNull(), F.col("_w")))).alias(b) for b in bands]
    classes = [F.min(F.when(nearest, F.col(x))).alias(x) for x in labels]
    kinds = {c: df.schema[c].dataType for c in ("row_px", "col_px")}
    out = rows.groupBy("sample_id", F.col("_row").alias("row_px"), F.col("_col").alias("col_px"), "height", "width").agg(*values, *classes)
    return out.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def crop(df: DataFrame, height: int = 256, width: int = 256, p: float = 1.0, seed: int = SEED) -> DataFrame:
    """A window at an offset that the patch's hash gives; patches that are smaller stay as they are on that axis."""
    on = _on("crop", p, seed)
    h, w = F.least(F.lit(height), F.col("height")), F.least(F.lit(width), F.col("width"))
    top = F.floor(coin(seed, F.col("sample_id"), "crop_row") * (F.col("height") - h + 1)).cast("int")
    left = F.floor(coin(seed, F.col("sample_id"), "crop_col") * (F.col("width") - w + 1)).cast("int")
    df = df.withColumns({"_on": on, "_top": top, "_left": left, "_h": h, "_w": w})
    inside = (F.col("row_px") >= F.col("_top")) & (F.col("row_px") < F.col("_top") + F.col("_h")) & (F.col("col_px") >= F.col("_left")) & (F.col("col_px") < F.col("_left") + F.col("_w"))
    df = df.where(~F.col("_on") | inside)
    new = {"row_px": F.col("row_px") - F.col("_top"), "col_px": F.col("col_px") - F.col("_left"), "height": F.col("_h"), "width": F.col("_w")}
    return df.withColumns({k: F.when(F.col("_on"), v).otherwise(F.col(k)) for k, v in new.items()}).drop("_on", "_top", "_left", "_h", "_w")


def _delta(op: str, limit: float, seed: int):
    return (coin(seed, F.col("sample_id"), op + "_by") * 2 - 1) * limit


def brightness(df: DataFrame, bands: tuple[str, ...] = (), limit: float = 0.2, p: float = 0.5, seed: int = SEED) -> DataFrame:
    return df.withColumns({b: F.when(_on("brightness", p, seed), F.col(b) + _delta("brightness", limit, seed)).otherwise(F.col(b)) for b in bands})


def contrast(df: DataFrame, bands: tuple[str, ...] = (), limit: float = 0.2, p: float = 0.5, seed: int = SEED) -> DataFrame:
    return df.withColumns({b: F.when(_on("contrast", p, seed), F.col(b) * (1 + _delta("contrast", limit, seed))).otherwise(F.col(b)) for b in bands})


REGISTRY: dict[str, Callable[..., DataFrame]] = {"flip": flip, "rotate": rotate, "rotate_by": rotate_by, "crop": crop, "brightness": brightness, "contrast": contrast}


def register(name: str, op: Callable[..., DataFrame], overwrite: bool = False) -> None:
    """Adds an operation for pipelines; one of the same name must be overwritten on purpose."""
    if name in REGISTRY and not overwrite:
        raise ValueError(f"operation {name} exists")
    REGISTRY[name] = op


def pipeline(df: DataFrame, steps: list[tuple[str, dict]], enabled: bool = True) -> DataFrame:
    """The named operations in order; an unknown one is an error."""
    for name, options in steps if enabled else []:
        if name not in REGISTRY:
            raise KeyError(f"unknown operation: {name}")
        df = df.transform(lambda d, f=REGISTRY[name], o=options: f(d, **o))
    return df
