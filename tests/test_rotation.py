"""Rotation by any angle against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.operators import augment as A

PIXELS = "sample_id long, row_px long, col_px int, height int, width int, b0 double, b1 double, label int"


def turned(image, labels, angle):
    """Inverse mapping of every target, one at a time; pixels outside and undefined ones have no weight."""
    h, w = labels.shape
    k, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    out, lab = np.full(image.shape, np.nan), np.full((h, w), -1)
    for tr in range(h):
        for tc in range(w):
            y, x = tr - (h - 1) / 2, tc - (w - 1) / 2
            r, c = round(k * y + s * x + (h - 1) / 2, 12), round(k * x - s * y + (w - 1) / 2, 12)
            cells = [(i, j, (1 - abs(r - i)) * (1 - abs(c - j))) for i in (int(np.floor(r)), int(np.floor(r)) + 1) for j in (int(np.floor(c)), int(np.floor(c)) + 1)]
            cells = [(i, j, g) for i, j, g in cells if 0 <= i < h and 0 <= j < w and g > 1e-9]
            for b in range(len(image)):
                own = [(image[b, i, j], g) for i, j, g in cells if not np.isnan(image[b, i, j])]
                if own:
                    out[b, tr, tc] = sum(v * g for v, g in own) / sum(g for _, g in own)
            i, j = int(np.floor(r + 0.5)), int(np.floor(c + 0.5))
            if 0 <= i < h and 0 <= j < w:
                lab[tr, tc] = labels[i, j]
    return out, lab


@pytest.mark.parametrize("angle", [0, 17.3, -45, 90, 180, 211.7])
def test_equals_inverse_mapping(spark, angle):
    rng = np.random.default_rng(3)
    rows, images = [], {}
    for sample, (h, w) in ((1, (9, 9)), (2, (6, 11)), (3, (1, 1)), (4, (8, 5))):
        image, labels = rng.normal(size=(2, h, w)) * 100, rng.integers(0, 4, (h, w))
        image[1, rng.random((h, w)) < 0.2] = np.nan
        images[sample] = image, labels
        rows += [(sample, r, c, h, w, *[None if np.isnan(v) else float(v) for v in image[:, r, c]], int(labels[r, c])) for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, PIXELS).withColumn("extra", F.lit(1))
    out = A.rotate_by(df, ("b0", "b1"), ("label",), angle=angle, p=1.1)
    got = {(r.sample_id, r.row_px, r.col_px): (r.b0, r.b1, r.label) for r in out.collect()}
    assert dict(out.dtypes)["row_px"] == "bigint" and dict(out.dtypes)["col_px"] == "int"
    for sample, (image, labels) in images.items():
        want, lab = turned(image, labels, angle)
        for (r, c), near in np.ndenumerate(want[0]):
            x = got.pop((sample, r, c), None)
            assert (x is None) == np.isnan(near)
            if x is None:
                continue
            assert abs(x[0] - near) < 1e-9 and (x[1] is None) == bool(np.isnan(want[1, r, c]))
            assert x[1] is None or abs(x[1] - want[1, r, c]) < 1e-9
            assert (-1 if x[2] is None else x[2]) == lab[r, c]
    assert not got


def test_quarters_and_coins(spark):
    rows = [(s, r, c, 6, 6, float(10 * r + c), 0.0, r % 4) for s in range(12) for r in range(6) for c in range(6)]
    df = spark.createDataFrame(rows, PIXELS)
    quarter = {tuple(r) for r in A.rotate(df, 1, p=1.1).select("sample_id", "row_px", "col_px", "b0", "label").collect()}
    by = {(r.sample_id, r.row_px, r.col_px, round(r.b0, 9), r.label) for r in A.pipeline(df, [("rotate_by", {"bands": ("b0",), "labels": ("label",), "angle": 90, "p": 1.1})]).collect()}
    assert by == quarter
    some = A.rotate_by(df, ("b0",), limit=30.0)
    kept = some.join(df.select("sample_id", "row_px", "col_px", F.col("b0").alias("old")), ["sample_id", "row_px", "col_px"]).groupBy("sample_id").agg(F.bool_and(F.abs(F.col("b0") - F.col("old")) < 1e-12).alias("same"))
    same = [r.same for r in kept.collect()]
    assert 0 < sum(same) < 12  # by the coin some stay as they are
    assert A.rotate_by(df.limit(0), ("b0",)).count() == 0
