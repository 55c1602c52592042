"""Column expressions: predicates, label and pixel transforms, names and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.functions.vocab import CLOUD_CLASSES, EPSILON, EXTENSIONS, PLACEHOLDERS, SEVERITY_THRESHOLDS


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def collapse_binary(label: Column, cloud: tuple[int, ...] = CLOUD_CLASSES) -> Column:
    """1 for cloud classes, else 0."""
    return label.isin(*cloud).cast("int")


def argmax(values: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def finite(x: Column) -> Column:
    """Null for NaN and infinities, which are missing in every statistic."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def mask_nodata(x: Column, nodata: float | None) -> Column:
    x = finite(x)
    return x if nodata is None else F.when(x != nodata, x)


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def normalize(x: Column, mode: str, stats: dict[str, Column] | None = None, fill: float = 0.0) -> Column:
    """A band value by one of four modes; missing values become ``fill``. ``stats``: min, max, mean, std, p_low, p_high."""
    if mode == "none":
        out = x
    elif mode == "minmax":
        out = (x - stats["min"]) / (stats["max"] - stats["min"] + EPSILON)
    elif mode == "zscore":
        out = (x - stats["mean"]) / (stats["std"] + EPSILON)
    elif mode == "percentile":
        out = (clip(x, stats["p_low"], stats["p_high"]) - stats["p_low"]) / (stats["p_high"] - stats["p_low"] + EPSILON)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return F.coalesce(out, F.lit(fill))


def ndsi(green: Column, swir: Column) -> Column:
    """The normalised difference snow index; null where either is missing or both sum to zero."""
    return F.try_divide(finite(green) - finite(swir), finite(green) + finite(swir))


def cirrus(band: Column, threshold: float = 0.01) -> Column:
    """Whether the cirrus band tells of thin cloud; null where it is missing."""
    return finite(band) >= threshold


def window_origin(transform: Column, row: Column, col: Column) -> Column:
    """The affine transform (a, b, c, d, e, f) of a window at a row and column of its parent."""
    t = [F.element_at(transform, i) for i in range(1, 7)]
    return F.array(t[0], t[1], t[2] + t[0] * col + t[1] * row, t[3], t[4], t[5] + t[3] * col + t[4] * row)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def supported_type(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return suffix(path).isin(*extensions)


def checksum_available(checksum: Column) -> Column:
    return ~F.upper(F.trim(F.coalesce(checksum, F.lit("")))).isin(*PLACEHOLDERS)


def checksum_matches(actual: Column, expected: Column) -> Column:
    """Equal without regard to case and outer spaces; a blank expectation is never met."""
    e = F.lower(F.trim(F.coalesce(expected, F.lit(""))))
    return (e != "") & (F.lower(F.trim(actual)) == e)


def manual_access(required: Column, urls: Column) -> Column:
    return required & (F.coalesce(F.size(urls), F.lit(0)) <= 0)


def severity(rate: Column, thresholds: dict[str, float] = SEVERITY_THRESHOLDS) -> Column:
    """NONE for null or no errors, else the highest level whose threshold the rate reaches, LOW below all."""
    levels = sorted(thresholds.items(), key=lambda x: -x[1])
    if any(not 0 < v <= 1 for _, v in levels) or len({v for _, v in levels}) < len(levels):
        raise ValueError("thresholds must be distinct and within (0, 1]")
    out = F.when(rate.isNull() | (rate <= 0), "NONE")
    for name, low in levels:
        out = out.when(rate >= low, name)
    return out.otherwise("LOW")


def severity_rank(name: Column) -> Column:
    return F.when(name == "CRITICAL", 4).when(name == "HIGH", 3).when(name == "MEDIUM", 2).when(name == "LOW", 1).otherwise(0)


def class_name(index: Column, names: dict[int, str]) -> Column:
    """The name of a class index, ``class_i`` if it has none."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, index), F.concat(F.lit("class_"), index))


def group_or(group: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), default)


def license_ok(text: Column) -> Column:
    return ~F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("prohibit"))


def provenance_known(source: Column, license: Column) -> Column:
    known = [F.upper(F.trim(F.coalesce(c, F.lit("UNKNOWN")))) != "UNKNOWN" for c in (source, license)]
    return known[0] & known[1]


def control(json: Column, path: str) -> Column:
    """A dotted path of nested controls as text; null if missing."""
    return F.get_json_object(json, "$." + path)


def format_metric(value: Column) -> Column:
    return F.coalesce(F.round(value, 6).cast("string"), F.lit("undefined"))


def size_label(height: Column, width: Column) -> Column:
    return F.concat_ws("x", height, width)


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_id(title: Column, content: Column) -> Column:
    return F.concat_ws("-", slug(title), F.substring(F.sha2(content, 256), 1, 8))


def axis_offsets(length: Column, patch: int, stride: int) -> Column:
    """0, stride, ... and the last offset that still fits; 0 alone if one patch covers the axis."""
    fits = F.array_union(F.sequence(F.lit(0), length - patch, F.lit(stride)), F.array(length - patch))
    return F.when(length <= patch, F.array(F.lit(0))).otherwise(fits)


def patch_grid(height: Column, width: Column, patch: int, overlap: int = 0) -> Column:
    """All windows of an image, row by row, none larger than the image."""
    stride = patch - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than the patch")
    rows, cols = axis_offsets(height, patch, stride), axis_offsets(width, patch, stride)
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("row_off"), c.alias("col_off"), F.least(F.lit(patch), height).alias("height"), F.least(F.lit(patch), width).alias("width")))))


def coin(seed: int, patch_id: Column, op: str) -> Column:
    """A number in [0, 1) of a seed, a patch and an operation."""
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), patch_id.cast("string"), F.lit(op)), 256), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)
