"""Band statistics, class distributions and dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.exprs import finite, mask_nodata, size_label
from evalframe.functions.vocab import PERCENTILES
from evalframe.sources.shared import checkpointed

STATS = ("min", "max", "mean", "std", "p_low", "p_high")


def long_bands(pixels: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """One row for each pixel and band: ``band`` and ``x``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col(b).alias("x")) for i, b in enumerate(bands)])).alias("b")
    return pixels.select(*keys, pairs).select(*keys, "b.band", "b.x")


#: Bits that each level of a selection drops: sign and exponent decide first, then 13 bits of the fraction at a time.
SHIFTS = (52, 39, 26, 13, 0)
#: Values of a cell that are counted one by one instead of by further bits.
DIRECT = 1 << 16


def _with(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined to those of a smaller table with equal keys, null keys included."""
    named = few.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if not keys:
        return rows.crossJoin(F.broadcast(named))  # one row
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return rows.join(named, on).drop(*[f"_r_{k}" for k in keys])


def with_order_key(rows: DataFrame, x: str, name: str) -> DataFrame:
    """Adds a whole number for each finite double, in the same order: its bits, those of negative numbers negated."""
    size, e, p = F.abs(x), F.col("_e"), F.lit(2.0)
    # the logarithm may be off by one next to a power of two; dividing by a power of two is exact. Each step is a column, so
    # that none is computed twice
    rows = rows.withColumn("_e", F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023))).withColumn("_m", size / F.pow(p, e))
    under, over = (F.col("_m") < 1) & (e > -1022), F.col("_m") >= 2
    rows = rows.withColumns({"_e": F.when(under, e - 1).when(over, e + 1).otherwise(e), "_m": F.when(under, F.col("_m") * 2).when(over, F.col("_m") / 2).otherwise(F.col("_m"))})
    # the smallest numbers alone are under 1 here
    rows = rows.withColumn("_e", F.when(F.col("_m") >= 1, (e + 1023) * F.lit(1 << 52) + ((F.col("_m") - 1) * F.lit(2.0**52)).cast("long")).otherwise((F.col("_m") * F.lit(2.0**52)).cast("long")))
    return rows.withColumn(name, F.when(F.col(x) == 0, F.lit(0).cast("long")).when(F.col(x) < 0, -e).otherwise(e)).drop("_e", "_m")


def _descend(rows: DataFrame, wanted: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """For each wanted rank the finer cell that holds it: the rank in it, and the rows of it."""
    group = [*keys, "_cell"]
    inside = _with(rows, wanted.select(*group).distinct(), group)
    counts = inside.groupBy(*group, F.shiftright("_k", shift).alias("_finer")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_finer").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**13 cells
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = _with(counts, wanted.select(*group, "_i", "_rank"), group).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    return found.select(*keys, "_i", F.col("_finer").alias("_cell"), (F.col("_rank") - F.col("_before")).alias("_rank"), "_n")


def exact_percentiles(rows: DataFrame, keys: list[str], column: str, points: list[float], direct: int = DIRECT) -> DataFrame:
    """(*keys, q): exact percentiles of each group's finite values, interpolated between neighbours; others play no part.

    A radix selection: values are counted by the leading bits of their order, then those in the few cells that hold a
    wanted rank by the next bits, until such cells have at most ``direct`` values, which are counted one by one. However
    they are spread, no task holds more of a group than 2**13 counts or the values of these cells.
    """
    x = finite(F.col(column).cast("double"))
    known = with_order_key(rows.select(*keys, x.alias("_x")).where("_x is not null"), "_x", "_k")
    counts = checkpointed(known.groupBy(*keys, F.shiftright("_k", SHIFTS[0]).alias("_cell")).agg(F.count("*").alias("_n")))
    group = [F.col(k) for k in keys] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**12 cells
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*group))})
    at = [F.col("_all") - 1 if p == 1 else (F.col("_all") - 1) * F.lit(float(p)) for p in points]
    ranks = F.array(*[f(r).cast("long") for r in at for f in (F.floor, F.ceil)])
    placed = counts.select(*keys, "_cell", "_n", "_before", "_all", F.posexplode(ranks).alias("_i", "_rank")).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    wanted = checkpointed(placed.select(*keys, "_i", "_cell", (F.col("_rank") - F.col("_before")).alias("_rank"), "_n", "_all"))
    totals, wanted, shift = wanted.select(*keys, "_all").distinct(), wanted.drop("_all"), SHIFTS[0]
    for finer in SHIFTS[1:]:
        if (wanted.agg(F.max("_n")).first()[0] or 0) <= direct:
            break
        cells = known.withColumn("_cell", F.shiftright("_k", shift))
        wanted, shift = checkpointed(_descend(cells, wanted, keys, finer)), finer
    values = _with(known.withColumn("_cell", F.shiftright("_k", shift)), wanted.select(*keys, "_cell").distinct(), [*keys, "_cell"])
    values = values.groupBy(*keys, "_cell", "_x").agg(F.count("*").alias("_m"))
    earlier = Window.partitionBy(*keys, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_first", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    held = _with(values, wanted.drop("_n"), [*keys, "_cell"]).where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_m")))
    one = held.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(f"_v{i}") for i in range(2 * len(points))])
    one = _with(one, totals, keys)
    q = [F.col(f"_v{2 * i}") + (r - F.floor(r)) * (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}")) for i, r in enumerate(at)]
    return one.select(*keys, F.array(*q).alias("q"))


def band_stats(pixels: DataFrame, bands: list[str], keys: list[str] | None = None, nodata: dict[str, float] | None = None, percentiles: tuple[float, float] | None = PERCENTILES, accuracy: int | None = None) -> DataFrame:
    """Minimum, maximum, mean, population deviation and two percentiles of the finite values of each band.

    A band without values has zeros. Percentiles interpolate between values and are exact; ``accuracy`` gives
    approximate ones in the same pass, and ``percentiles`` None leaves them out.
    """
    keys, nodata = keys or [], nodata or {}
    masked = {b: mask_nodata(F.col(b), nodata.get(b)) for b in bands}
    aggs: list[Column] = []
    for i, b in enumerate(bands):
        x = masked[b]
        fields = [F.lit(i).alias("band"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")]
        if percentiles and accuracy is not None:
            fields.append(F.percentile_approx(x, [p / 100 for p in percentiles], accuracy).alias("q"))
        aggs.append(F.struct(*fields).alias(f"s{i}"))
    wide = pixels.groupBy(*keys).agg(*aggs)
    zero = F.lit(0.0)
    rows = wide.select(*keys, F.inline(F.array(*[f"s{i}" for i in range(len(bands))])))
    if percentiles and accuracy is None:
        own = [*keys, "band"]
        values = long_bands(pixels.select(*keys, *[x.alias(b) for b, x in masked.items()]), bands, keys)
        q = exact_percentiles(values, own, "x", [p / 100 for p in percentiles]).withColumnsRenamed({k: f"_q_{k}" for k in own})
        rows = rows.join(q, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in own], "left")
    out = [*keys, "band", *[F.coalesce(c, zero).alias(c) for c in STATS[:4]]]
    if percentiles:
        out += [F.coalesce(F.try_element_at("q", F.lit(i + 1)), zero).alias(c) for i, c in enumerate(STATS[4:])]
    return rows.select(*out)


def fit_on_split(pixels: DataFrame, splits: DataFrame, bands: list[str], split: str = "train", **options) -> DataFrame:
    """Band statistics over the samples of one split. The split must not be empty: an empty one fails the job."""
    own = pixels.join(splits.where(F.col("split") == split).select("sample_id").distinct(), "sample_id", "left_semi")
    some = own.agg(F.count("*").alias("_pixels"))  # one row
    out = band_stats(own, bands, **options).crossJoin(F.broadcast(some))
    return out.where(F.assert_true(F.col("_pixels") > 0, F.lit("the split has no pixels")).isNull()).drop("_pixels")


def class_distribution(pixels: DataFrame, splits: DataFrame, classes: DataFrame) -> DataFrame:
    """For each class: pixels in all and in each split, and samples that hold it; classes without pixels have zeros."""
    labelled = pixels.join(splits.select("sample_id", "split"), "sample_id")
    each = labelled.groupBy("sample_id", "split", F.col("label").alias("class_index")).agg(F.count("*").alias("n"))
    rows = each.groupBy("class_index").agg(F.sum("n").alias("pixels"), F.count("*").alias("samples"), *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_pixels") for s in ("train", "val", "test")])
    counts = ["pixels", "samples", "train_pixels", "val_pixels", "test_pixels"]
    return classes.join(rows, "class_index", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def distribution_ratios(distribution: DataFrame, focus: str) -> DataFrame:
    """One row: focus fraction, smallest to largest class, severe imbalance under 0.05."""
    total = F.sum("pixels")
    out = distribution.agg(total.alias("total"), F.try_divide(F.sum(F.when(F.col("class_name") == focus, F.col("pixels"))), total).alias("focus_fraction"), F.try_divide(F.min("pixels"), F.max("pixels")).alias("balance_ratio"))
    return out.withColumn("severe_imbalance", F.coalesce(F.col("balance_ratio") < 0.05, F.lit(False)))


def class_frequency(counts: DataFrame) -> DataFrame:
    """Shares of counts by class; the total is of a table of few rows."""
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("frequency", F.try_divide("n", "total"))


def dataset_statistics(samples: DataFrame, sizes: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each dataset: samples, missing labels, distinct samples with issues, sizes."""
    own = samples.groupBy("dataset").agg(F.count("*").alias("samples"), F.count_if(F.col("label").isNull()).alias("missing_labels"))
    bad = samples.select("sample_id", "dataset").join(issues.select("sample_id").distinct(), "sample_id", "left_semi").groupBy("dataset").agg(F.count("*").alias("with_issues"))
    dims = samples.select("sample_id", "dataset").join(sizes, "sample_id").groupBy("dataset").agg(F.count_distinct(size_label(F.col("height"), F.col("width"))).alias("sizes"))
    return own.join(bad, "dataset", "left").join(dims, "dataset", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("with_issues", "sizes")})


def patch_statistics(patches: DataFrame) -> DataFrame:
    """Numbers of patches: in all, by split, by sample."""
    g = patches.groupingSets([[F.col("split")], [F.col("sample_id")], []], "split", "sample_id").agg(F.count("*").alias("patches"), F.grouping_id("split", "sample_id").alias("level"))
    level = F.when(F.col("level") == 1, "split").when(F.col("level") == 2, "sample").otherwise("all")
    return g.select(level.alias("level"), F.coalesce("split", "sample_id", F.lit("")).alias("item"), "patches")


def split_statistics(splits: DataFrame) -> DataFrame:
    """Number and share of samples in each split; empty splits have zeros."""
    spark = splits.sparkSession
    names = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    counts = splits.groupBy("split").agg(F.count("*").alias("n"))
    total = splits.agg(F.count("*").alias("total"))  # one row
    out = names.join(F.broadcast(counts), "split", "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("split", "n", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("ratio"))
