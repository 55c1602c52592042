"""Queries on pixels and image sizes: masks, normalization, statistics, tiling, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import exprs as X
from evalframe.functions.vocab import CLASSES, FALSE_COLOR_BANDS, FOCUS_CLASS, RGB_BANDS, classes, values_sql
from evalframe.operators import augment as A
from evalframe.operators import stats as S
from evalframe.operators import tiling as T
from evalframe.queries.fixtures import query

BANDS = ["b0", "b1", "b2", "b3"]
CLASS_TABLE = f"(SELECT * FROM {values_sql(CLASSES, 'class_index, class_name')})"


def stats_sql(source: str = "pixels", key: str = "scene", band: str = "b{i}") -> str:
    """Band statistics in SQL; band 0 has nodata 50."""
    k = f"{key}, " if key else ""
    parts = []
    for i in range(4):
        x = f"CASE WHEN b{i} <> 50.0 THEN b{i} END" if i == 0 else f"b{i}"
        parts.append(f"SELECT {k}{i} AS band, min({x}) AS \"min\", max({x}) AS \"max\", avg({x}) AS mean, stddev_pop({x}) AS std, quantile_cont({x}, 0.02) AS p_low, quantile_cont({x}, 0.98) AS p_high FROM {source} GROUP BY ALL")
    return " UNION ALL ".join(parts)


STATS_ROUNDED = ", ".join(f'round("{c}", 6) AS "{c}"' for c in S.STATS)
NODATA = {"b0": 50.0}


def band_stats(t, keys=("scene",), **options):
    return S.band_stats(t.pixels, BANDS, list(keys), NODATA, **options)


def r(df, cols=S.STATS):
    return df.withColumns({c: X.r6(F.col(c)) for c in cols})


@query("g13_band_stats", f"SELECT scene, band, {STATS_ROUNDED} FROM ({stats_sql()})")
def _(t):
    return r(band_stats(t))


SPLITS = "SELECT DISTINCT sample_id, CASE WHEN sample_id % 20 < 14 THEN 'train' WHEN sample_id % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM pixels"


def pixel_splits(t):
    k = F.pmod("sample_id", F.lit(20))
    return t.pixels.select("sample_id", F.when(k < 14, "train").when(k < 17, "val").otherwise("test").alias("split")).distinct()


@query("g14_fit_train_only", f"SELECT band, {STATS_ROUNDED} FROM ({stats_sql('(SELECT * FROM pixels WHERE sample_id % 20 < 14)', '')})")
def _(t):
    return r(S.fit_on_split(t.pixels, pixel_splits(t), BANDS, nodata=NODATA))


DIST = f"""SELECT k.class_index, class_name, CAST(count(p.label) AS BIGINT) AS pixels, count(DISTINCT p.sample_id) AS samples,
 count(CASE WHEN p.sample_id % 20 < 14 THEN 1 END) AS train_pixels, count(CASE WHEN p.sample_id % 20 BETWEEN 14 AND 16 THEN 1 END) AS val_pixels,
 count(CASE WHEN p.sample_id % 20 > 16 THEN 1 END) AS test_pixels FROM {CLASS_TABLE} k LEFT JOIN pixels p ON p.label = k.class_index GROUP BY ALL"""


def distribution(t):
    return S.class_distribution(t.pixels, pixel_splits(t), classes(t.spark))


@query("g15_class_distribution", DIST)
def _(t):
    return distribution(t)


@query("g16_distribution_ratios", f"""SELECT CAST(sum(pixels) AS BIGINT) AS total, round(sum(CASE WHEN class_name = '{FOCUS_CLASS}' THEN pixels END) / sum(pixels), 6) AS focus_fraction,
 round(min(pixels) / max(pixels), 6) AS balance_ratio, min(pixels) / max(pixels) < 0.05 AS severe_imbalance FROM ({DIST})""")
def _(t):
    return r(S.distribution_ratios(distribution(t), FOCUS_CLASS), ["focus_fraction", "balance_ratio"])


@query("g17_class_frequency", "SELECT label, count(*) AS n, CAST((SELECT count(*) FROM pixels) AS BIGINT) AS total, round(count(*) / (SELECT count(*) FROM pixels), 6) AS frequency FROM pixels GROUP BY ALL")
def _(t):
    return r(S.class_frequency(t.pixels.groupBy("label").agg(F.count("*").alias("n"))), ["frequency"])


@query("g18_dataset_statistics", """SELECT s.dataset, count(*) AS samples, count(*) - count(label) AS missing_labels, count(CASE WHEN n_bytes < 200 THEN 1 END) AS with_issues,
 count(DISTINCT CAST(height AS VARCHAR) || 'x' || CAST(width AS VARCHAR)) AS sizes FROM samples s JOIN image_sizes i ON s.sample_id = i.sample_id GROUP BY ALL""")
def _(t):
    return S.dataset_statistics(t.samples, t.image_sizes, t.samples.where("n_bytes < 200"))


@query("p03_nodata_mask", "SELECT sample_id, row_px, col_px, CASE WHEN b0 <> 50.0 THEN b0 END AS b0 FROM pixels")
def _(t):
    return t.pixels.select("sample_id", "row_px", "col_px", X.mask_nodata(F.col("b0"), 50.0).alias("b0"))


@query("p04_clip", "SELECT sample_id, row_px, col_px, least(greatest(b1, 5000), 40000) AS b1 FROM pixels")
def _(t):
    return t.pixels.select("sample_id", "row_px", "col_px", X.clip(F.col("b1"), 5000.0, 40000.0).alias("b1"))


@query("p05_normalize_none", "SELECT sample_id, row_px, col_px, coalesce(CASE WHEN b0 <> 50.0 THEN b0 END, 0.0) AS b0 FROM pixels")
def _(t):
    return t.pixels.select("sample_id", "row_px", "col_px", X.normalize(X.mask_nodata(F.col("b0"), 50.0), "none").alias("b0"))


def normalized(t, mode):
    """All bands, each by its own statistics in its scene."""
    stats = band_stats(t, **({} if mode == "percentile" else {"percentiles": None}))
    names = [c for c in stats.columns if c not in ("scene", "band")]
    wide = stats.groupBy("scene").pivot("band", list(range(len(BANDS)))).agg(F.first(F.struct(*names)))  # one row for each scene
    rows = t.pixels.join(wide, "scene")
    out = [X.r6(X.normalize(X.mask_nodata(F.col(b), NODATA.get(b)), mode, {s: F.col(f"`{i}`")[s] for s in names})).alias(b) for i, b in enumerate(BANDS)]
    return rows.select("sample_id", "row_px", "col_px", *out)


def normalized_sql(expr: str) -> str:
    """``expr`` in terms of x, its band's value, and s, its statistics."""
    made = []
    for i, b in enumerate(BANDS):
        value = f"(CASE WHEN {b} <> {NODATA[b]} THEN {b} END)" if b in NODATA else b
        made.append(f"round(coalesce({expr.replace('{x}', value).replace('s.', f's{i}.')}, 0.0), 6) AS {b}")
    joins = " ".join(f"JOIN stats s{i} ON p.scene = s{i}.scene AND s{i}.band = {i}" for i in range(len(BANDS)))
    return f"WITH stats AS ({stats_sql()}) SELECT p.sample_id, p.row_px, p.col_px, {', '.join(made)} FROM pixels p {joins}"


@query("p06_normalize_minmax", normalized_sql('({x} - s."min") / (s."max" - s."min" + 1e-8)'))
def _(t):
    return normalized(t, "minmax")


@query("p07_normalize_zscore", normalized_sql("({x} - s.mean) / (s.std + 1e-8)"))
def _(t):
    return normalized(t, "zscore")


@query("p08_normalize_percentile", normalized_sql("(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, s.p_low), s.p_high) END - s.p_low) / (s.p_high - s.p_low + 1e-8)"))
def _(t):
    return normalized(t, "percentile")


_RGB = {"red": "b1", "green": "b2", "blue": "b3"}
_STRETCH = ", ".join(f"round(CASE WHEN hi - lo < 1e-9 THEN least(greatest({b}, 0), 1) ELSE least(greatest(({b} - lo) / (hi - lo), 0), 1) END, 6) AS {c}" for c, b in _RGB.items())


@query("p09_percentile_stretch", f"""WITH r AS (SELECT scene, unnest([b1, b2, b3]) AS x FROM pixels), q AS (SELECT scene, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM r GROUP BY ALL)
SELECT p.sample_id, p.row_px, p.col_px, {_STRETCH} FROM pixels p JOIN q ON q.scene = p.scene""")
def _(t):
    rgb = S.long_bands(t.pixels, list(_RGB.values()), ["scene"])
    q = S.exact_percentiles(rgb, ["scene"], "x", [0.02, 0.98]).select("scene", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    flat, span = F.col("hi") - F.col("lo") < 1e-9, F.col("hi") - F.col("lo")
    color = lambda b: F.when(flat, X.clip(F.col(b), 0.0, 1.0)).otherwise(X.clip(F.try_divide(F.col(b) - F.col("lo"), span), 0.0, 1.0))
    return t.pixels.join(q, "scene").select("sample_id", "row_px", "col_px", *[X.r6(color(b)).alias(c) for c, b in _RGB.items()])


@query("p34_spectral_indices", "SELECT sample_id, row_px, col_px, round((b0 - b1 / 1000) / nullif(b0 + b1 / 1000, 0), 6) AS ndsi, b2 >= 0.05 AS cirrus FROM pixels")
def _(t):
    b = t.pixels
    return b.select("sample_id", "row_px", "col_px", X.r6(X.ndsi(F.col("b0"), F.col("b1") / 1000)).alias("ndsi"), X.cirrus(F.col("b2"), 0.05).alias("cirrus"))


@query("p10_band_select", "SELECT sample_id, row_px, col_px, b2 AS red, b1 AS green, b0 AS blue, b3 AS nir FROM pixels")
def _(t):
    bands = F.array(*BANDS)
    rgb, false = RGB_BANDS[4], FALSE_COLOR_BANDS[4]
    return t.pixels.select("sample_id", "row_px", "col_px", *[F.element_at(bands, i + 1).alias(n) for i, n in zip((*rgb, false[0]), ("red", "green", "blue", "nir"))])


@query("p11_window_transform", "SELECT sample_id, CAST(500000.0 + 10.0 * (width % 7) AS DOUBLE) AS c, CAST(4000000.0 - 10.0 * (height % 5) AS DOUBLE) AS f FROM image_sizes")
def _(t):
    tr = F.array(*[F.lit(float(x)) for x in (10, 0, 500000, 0, -10, 4000000)])
    w = X.window_origin(tr, F.col("height") % 5, F.col("width") % 7)
    return t.image_sizes.select("sample_id", w[2].alias("c"), w[5].alias("f"))


@query("p28_size_label", "SELECT sample_id, height || 'x' || width AS size FROM image_sizes")
def _(t):
    return t.image_sizes.select("sample_id", X.size_label(F.col("height"), F.col("width")).alias("size"))


PATCH, OVER = 256, 32


def offsets_sql(length: str, patch: int = PATCH, over: int = OVER) -> str:
    s = patch - over
    return f"CASE WHEN {length} <= {patch} THEN [0] ELSE list_sort(list_distinct(list_append(range(0, {length} - {patch} + 1, {s}), {length} - {patch}))) END"


@query("f01_axis_offsets", f"SELECT sample_id, array_to_string({offsets_sql('height')}, ',') AS offsets FROM image_sizes")
def _(t):
    return t.image_sizes.select("sample_id", F.array_join(X.axis_offsets(F.col("height"), PATCH, PATCH - OVER).cast("array<string>"), ",").alias("offsets"))


GRID = f"""SELECT sample_id, height, width, CAST(row_off AS INT) AS row_off, CAST(col_off AS INT) AS col_off, CAST(least(height, {PATCH}) AS INT) AS h, CAST(least(width, {PATCH}) AS INT) AS w,
 CAST(row_number() OVER (PARTITION BY sample_id ORDER BY row_off, col_off) - 1 AS INT) AS patch_index
 FROM (SELECT *, unnest({offsets_sql('width')}) AS col_off FROM (SELECT *, unnest({offsets_sql('height')}) AS row_off FROM image_sizes))"""


@query("f02_patch_grid", f"SELECT sample_id, row_off, col_off, h AS height, w AS width FROM ({GRID})")
def _(t):
    return t.image_sizes.select("sample_id", F.explode(X.patch_grid(F.col("height"), F.col("width"), PATCH, OVER)).alias("w")).select("sample_id", "w.*")


SAMPLE_SPLITS = "SELECT sample_id, CASE WHEN n_bytes % 10 < 7 THEN 'train' WHEN n_bytes % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM samples"


def sample_splits(t):
    k = F.pmod("n_bytes", F.lit(10))
    return t.samples.select("sample_id", F.when(k < 7, "train").when(k == 7, "val").otherwise("test").alias("split"))


def manifest(t):
    return T.patch_manifest(t.samples, t.image_sizes, sample_splits(t), PATCH, OVER)


MANIFEST = f"""SELECT g.sample_id || '_' || patch_index AS patch_id, g.sample_id, s.dataset, coalesce(split, 'train') AS split, patch_index, row_off, col_off, h AS height, w AS width,
 g.height AS image_height, g.width AS image_width, {PATCH} AS patch_size, {OVER} AS overlap, '1' AS version
 FROM ({GRID}) g JOIN samples s ON s.sample_id = g.sample_id LEFT JOIN ({SAMPLE_SPLITS}) p ON p.sample_id = g.sample_id"""


@query("f03_patch_manifest", MANIFEST)
def _(t):
    return manifest(t)


@query("f04_patch_count_estimate", f"SELECT sample_id, CAST(len({offsets_sql('height')}) * len({offsets_sql('width')}) AS INT) AS patches FROM image_sizes")
def _(t):
    return t.image_sizes.select("sample_id", F.size(X.patch_grid(F.col("height"), F.col("width"), PATCH, OVER)).alias("patches"))


@query("f05_patch_grid_metadata", f"SELECT sample_id, string_agg(patch_index || ':' || row_off || ':' || col_off, ',' ORDER BY patch_index) AS windows, true AS has_overlap FROM ({GRID}) GROUP BY ALL")
def _(t):
    meta = T.grid_metadata(manifest(t))
    text = F.array_join(F.transform("windows", lambda w: F.concat_ws(":", w["patch_index"], w["row_off"], w["col_off"])), ",")
    return meta.select("sample_id", text.alias("windows"), "has_overlap")


def sized_pixels(t):
    return t.pixels.withColumns({"height": F.lit(97), "width": F.lit(31)})


TILES = f"""SELECT p.*, CAST(r.o AS INT) AS row_off, CAST(c.o AS INT) AS col_off FROM pixels p JOIN (SELECT unnest({offsets_sql('97', 16, 4)}) AS o) r ON r.o <= row_px AND row_px < r.o + 16
 JOIN (SELECT unnest({offsets_sql('31', 16, 4)}) AS o) c ON c.o <= col_px AND col_px < c.o + 16"""


@query("j09_pixel_patch_range", f"SELECT sample_id, row_px, col_px, row_off, col_off, b0 FROM ({TILES})")
def _(t):
    return T.pixels_by_patch(sized_pixels(t), 16, 4).select("sample_id", "row_px", "col_px", "row_off", "col_off", "b0")


@query("f06_patch_normalize", f"""WITH t AS ({TILES}), s AS (SELECT sample_id, row_off, col_off, min(b1) AS lo, max(b1) AS hi FROM t GROUP BY ALL)
SELECT t.sample_id, row_px, col_px, t.row_off, t.col_off, round((b1 - lo) / (hi - lo + 1e-8), 6) AS b1 FROM t JOIN s ON t.sample_id = s.sample_id AND t.row_off = s.row_off AND t.col_off = s.col_off""")
def _(t):
    out = T.normalize_patches(sized_pixels(t), ["b1"], "minmax", 16, 4)
    return out.select("sample_id", "row_px", "col_px", "row_off", "col_off", X.r6(F.col("b1")).alias("b1"))


@query("w07_patch_index", f"SELECT sample_id, patch_index, row_off, col_off FROM ({GRID})")
def _(t):
    return manifest(t).select("sample_id", "patch_index", "row_off", "col_off")


@query("g19_patch_statistics", f"SELECT 'all' AS level, '' AS item, count(*) AS patches FROM ({MANIFEST}) UNION ALL SELECT 'split', split, count(*) FROM ({MANIFEST}) GROUP BY ALL UNION ALL SELECT 'sample', sample_id, count(*) FROM ({MANIFEST}) GROUP BY ALL")
def _(t):
    return S.patch_statistics(manifest(t))


@query("g20_split_statistics", f"SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM ({SAMPLE_SPLITS})), 6) AS ratio FROM ({SAMPLE_SPLITS}) GROUP BY ALL")
def _(t):
    return r(S.split_statistics(sample_splits(t)), ["ratio"])


@query("j02_patch_split_lookup", f"SELECT s.sample_id, s.dataset, coalesce(split, 'train') AS split FROM samples s LEFT JOIN ({SAMPLE_SPLITS}) p ON p.sample_id = s.sample_id")
def _(t):
    return T.split_lookup(t.samples.select("sample_id", "dataset"), sample_splits(t))


@query("j03_image_size_join", "SELECT s.sample_id, s.dataset, height, width FROM samples s JOIN image_sizes i ON s.sample_id = i.sample_id")
def _(t):
    return t.samples.select("sample_id", "dataset").join(t.image_sizes, "sample_id")


def coin_sql(op: str) -> str:
    hexa = f"substr(sha256('42|' || sample_id || '|{op}'), 1, 8)"
    return f"CAST(CAST('0x' || {hexa} AS BIGINT) AS DOUBLE) / 4294967296.0"


COLS = "sample_id, CAST({r} AS BIGINT) AS row_px, CAST({c} AS BIGINT) AS col_px, round({v}, 6) AS b1"


def coords(df):
    return df.select("sample_id", F.col("row_px").cast("long").alias("row_px"), F.col("col_px").cast("long").alias("col_px"), X.r6(F.col("b1")).alias("b1"))


@query("a01_flip", f"SELECT {COLS.format(r='row_px', c=f'CASE WHEN {coin_sql('flip')} < 0.5 THEN 30 - col_px ELSE col_px END', v='b1')} FROM pixels")
def _(t):
    return coords(A.flip(sized_pixels(t)))


@query("a02_rotate", f"SELECT {COLS.format(r=f'CASE WHEN {coin_sql('rotate')} < 0.5 THEN 30 - col_px ELSE row_px END', c=f'CASE WHEN {coin_sql('rotate')} < 0.5 THEN row_px ELSE col_px END', v='b1')} FROM pixels")
def _(t):
    return coords(A.rotate(sized_pixels(t)))


_TOP, _LEFT = f"CAST(floor({coin_sql('crop_row')} * 34) AS INT)", f"CAST(floor({coin_sql('crop_col')} * 16) AS INT)"


@query("a03_crop", f"SELECT {COLS.format(r=f'row_px - {_TOP}', c=f'col_px - {_LEFT}', v='b1')} FROM pixels WHERE row_px BETWEEN {_TOP} AND {_TOP} + 63 AND col_px BETWEEN {_LEFT} AND {_LEFT} + 15")
def _(t):
    return coords(A.crop(sized_pixels(t), 64, 16))


def _by(op: str) -> str:
    return f"(({coin_sql(op + '_by')}) * 2 - 1) * 0.2"


BRIGHT = f"CASE WHEN {coin_sql('brightness')} < 0.5 THEN b1 + {_by('brightness')} ELSE b1 END"


@query("a04_brightness", f"SELECT {COLS.format(r='row_px', c='col_px', v=BRIGHT)} FROM pixels")
def _(t):
    return coords(A.brightness(sized_pixels(t), ("b1",)))


@query("a05_contrast", f"SELECT {COLS.format(r='row_px', c='col_px', v=f'CASE WHEN {coin_sql('contrast')} < 0.5 THEN b1 * (1 + {_by('contrast')}) ELSE b1 END')} FROM pixels")
def _(t):
    return coords(A.contrast(sized_pixels(t), ("b1",)))


@query("a06_pipeline", f"SELECT {COLS.format(r='row_px', c=f'CASE WHEN {coin_sql('flip')} < 0.5 THEN 30 - col_px ELSE col_px END', v=BRIGHT)} FROM pixels")
def _(t):
    return coords(A.pipeline(sized_pixels(t), [("flip", {}), ("brightness", {"bands": ("b1",)})]))


_ANGLE = f"radians(CASE WHEN {coin_sql('rotate')} < 0.5 THEN (({coin_sql('rotate_by')}) * 2 - 1) * 45 ELSE 0 END)"


@query("a07_rotate_by", f"""WITH turned AS (SELECT sample_id, row_px - 48.0 AS r, col_px - 15.0 AS c, b1, label, cos({_ANGLE}) AS k, sin({_ANGLE}) AS s FROM pixels),
 near AS (SELECT *, CAST(floor(k * r - s * c + 48) AS INT) + unnest([-1, 0, 1, 2, -1, 0, 1, 2, -1, 0, 1, 2, -1, 0, 1, 2]) AS tr, CAST(floor(s * r + k * c + 15) AS INT) + unnest([-1, -1, -1, -1, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]) AS tc FROM turned),
 off AS (SELECT *, round(k * (tr - 48) + s * (tc - 15) - r, 12) AS dr, round(k * (tc - 15) - s * (tr - 48) - c, 12) AS dc FROM near WHERE tr BETWEEN 0 AND 96 AND tc BETWEEN 0 AND 30),
 weighed AS (SELECT *, (1 - abs(dr)) * (1 - abs(dc)) AS w FROM off WHERE abs(dr) < 1 AND abs(dc) < 1)
 SELECT sample_id, CAST(tr AS BIGINT) AS row_px, CAST(tc AS BIGINT) AS col_px, round(sum(w * b1) / sum(w), 4) AS b1, min(CASE WHEN dr >= -0.5 AND dr < 0.5 AND dc >= -0.5 AND dc < 0.5 THEN label END) AS label FROM weighed WHERE w > 1e-9 GROUP BY sample_id, tr, tc""")
def _(t):
    out = A.rotate_by(sized_pixels(t), ("b1",), ("label",), limit=45.0)
    return out.select("sample_id", "row_px", "col_px", F.round("b1", 4).alias("b1"), "label")
