"""Failure analysis: error records of classes, failing samples, summaries, hard examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.exprs import group_or, severity, severity_rank
from evalframe.functions.vocab import CLASS_CATEGORIES, SEVERITIES, TAXONOMY
from evalframe.operators import ranking as R

TYPES = ("false_positive", "false_negative", "class_confusion")


def dominant(table: DataFrame, keys: list[str], of: str, other: str) -> DataFrame:
    """The largest off-diagonal cell of each row (or column) of a confusion table, ties to the lower index; none if all are zero."""
    w = Window.partitionBy(*keys, of).orderBy(F.col("n").desc(), F.col(other))
    off = table.where((F.col(of) != F.col(other)) & (F.col("n") > 0))
    return off.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def error_records(table: DataFrame, counts: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    """False negatives, false positives and the dominant confusion of each class, ranked within each key."""
    name = {c: names.select(F.col("class_index").alias(c), F.col("class_name").alias(f"{c}_name")) for c in ("true_class", "pred_class")}
    rows = dominant(table, keys, "true_class", "pred_class").select(*keys, F.col("true_class").alias("class_index"), F.col("pred_class").alias("row_pred"), F.col("n").alias("row_n"))
    cols = dominant(table, keys, "pred_class", "true_class").select(*keys, F.col("pred_class").alias("class_index"), F.col("true_class").alias("col_true"))
    base = counts.join(rows, [*keys, "class_index"], "left").join(cols, [*keys, "class_index"], "left")
    base = base.join(F.broadcast(name["pred_class"].withColumnRenamed("pred_class", "row_pred")), "row_pred", "left").join(F.broadcast(name["true_class"].withColumnRenamed("true_class", "col_true")), "col_true", "left")

    def record(kind: str, predicted, count, denominator, source):
        return F.struct(F.lit(kind).alias("error_type"), predicted.alias("predicted_class"), count.cast("long").alias("error_count"), denominator.cast("long").alias("support"), source.alias("dominant_source"))

    none = F.lit(None).cast("string")
    made = F.array(
        record("false_negative", F.col("pred_class_name"), F.col("fn"), F.col("support"), none),
        record("false_positive", F.col("class_name"), F.col("fp"), F.col("predicted"), F.col("true_class_name")),
        F.when(F.col("row_n") > 0, record("class_confusion", F.col("pred_class_name"), F.col("row_n"), F.col("support"), none)),
    )
    out = base.select(*keys, "class_name", F.explode(F.array_compact(made)).alias("e")).select(*keys, "class_name", "e.*")
    out = out.withColumn("error_rate", F.try_divide("error_count", "support")).withColumn("severity", severity(F.col("error_rate")))
    w = Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")).desc(), F.coalesce("error_rate", F.lit(0.0)).desc(), F.col("error_count").desc(), "class_name", "error_type")
    return out.withColumn("rank", F.row_number().over(w))


def sample_failures(rows: DataFrame, keys: list[str], names: dict[int, str], multiclass: bool = True, ignore: int | None = None) -> DataFrame:
    """One row for each sample: totals, rate, false negatives by class, dominant confusion, categories, severity.

    ``rows``: keys, sample_id, group_id, true_class, pred_class. A sample all of whose pixels are ignored has rate 0.
    """
    t, p = F.col("true_class"), F.col("pred_class")
    counted = F.lit(True) if ignore is None else t != ignore
    cells = rows.groupBy(*keys, "sample_id", "group_id", "true_class", "pred_class").agg(F.count_if(counted).alias("n"))
    wrong = (t != p) & (F.col("n") > 0)
    per_class = F.map_filter(F.map_from_arrays(F.array(*[F.lit(v) for v in names.values()]), F.array(*[F.coalesce(F.sum(F.when(wrong & (t == k), F.col("n"))), F.lit(0)) for k in names])), lambda k, v: v > 0)
    worst = F.min_by(F.struct("true_class", "pred_class"), F.when(wrong, F.struct((-F.col("n")).alias("n"), "true_class", "pred_class")))
    out = cells.groupBy(*keys, "sample_id", "group_id").agg(F.sum("n").alias("total_pixels"), F.coalesce(F.sum(F.when(wrong, F.col("n"))), F.lit(0)).alias("error_count"), per_class.alias("per_class_errors"), worst.alias("_w"))
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    has = F.size("per_class_errors") > 0
    out = out.withColumns({
        "error_rate": F.coalesce(F.try_divide("error_count", "total_pixels"), F.lit(0.0)),
        "dominant_true_class": F.when(has, F.try_element_at(lookup, F.col("_w.true_class"))).otherwise(""),
        "dominant_predicted_class": F.when(has, F.try_element_at(lookup, F.col("_w.pred_class"))).otherwise(""),
    })
    category = F.create_map(*[F.lit(x) for kv in CLASS_CATEGORIES for x in kv])
    own = F.array_compact(F.transform(F.map_keys("per_class_errors"), lambda c: F.try_element_at(category, c))) if multiclass else F.array().cast("array<string>")
    categories = F.when(F.col("error_count") > 0, F.concat(F.array(*map(F.lit, TYPES)), own)).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"severity": severity(F.col("error_rate")), "categories": categories}).drop("_w")


def failing(samples: DataFrame) -> DataFrame:
    return samples.where("error_count > 0")


def severity_map(extra: str = ""):
    """Counts by severity as a map, without zeros."""
    counts = F.map_from_arrays(F.array(*map(F.lit, SEVERITIES)), F.array(*[F.count_if(F.col("severity") == s) for s in SEVERITIES]))
    return F.map_filter(counts, lambda k, v: v > 0)


def class_summary(records: DataFrame, failures: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    """For each true class: false negatives, rate, failing samples that have it among their errors, severities of these."""
    fn = records.where("error_type = 'false_negative'").select(*keys, "class_name", F.col("error_count").alias("total_errors"), "error_rate")
    each = failures.select(*keys, "severity", F.explode(F.map_keys("per_class_errors")).alias("class_name"))
    seen = each.groupBy(*keys, "class_name").agg(F.count("*").alias("sample_count"), severity_map().alias("severity_distribution"))
    return fn.join(seen, [*keys, "class_name"], "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def error_type_summary(records: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    totals = records.groupBy(*keys, "error_type").agg(F.sum("error_count").alias("total_errors"))
    each = failures.select(*keys, F.explode(F.array_intersect("categories", F.array(*map(F.lit, TYPES)))).alias("error_type"))
    seen = each.groupBy(*keys, "error_type").agg(F.count("*").alias("sample_count"))
    return totals.join(seen, [*keys, "error_type"], "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def group_summary(failures: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of samples: errors, samples, ratio of sums, severities."""
    g = group_or(F.col("group_id"), F.lit("_ungrouped")).alias("stratum")
    return failures.groupBy(*keys, g).agg(F.sum("error_count").alias("total_errors"), F.count("*").alias("sample_count"), F.try_divide(F.sum("error_count"), F.sum("total_pixels")).alias("error_rate"), severity_map().alias("severity_distribution"))


def arm_summary(records: DataFrame, failures: DataFrame, keys: list[str], focus: str) -> DataFrame:
    """Totals of each model: failing samples (false negatives if there are none), error types, focus class, severities."""
    by = {k: F.sum(F.when(F.col("error_type") == k, F.col("error_count")).otherwise(0)) for k in TYPES}
    totals = records.groupBy(*keys).agg(by["false_positive"].alias("false_positives"), by["false_negative"].alias("false_negatives"), by["class_confusion"].alias("class_confusion"), F.sum(F.when((F.col("error_type") == "false_negative") & (F.col("class_name") == focus), F.col("error_count")).otherwise(0)).alias("focus_failures"))
    seen = failures.groupBy(*keys).agg(F.count("*").alias("_samples"), severity_map().alias("severity_distribution"))
    out = totals.join(seen, keys, "left")
    return out.withColumn("total_failures", F.coalesce("_samples", "false_negatives")).drop("_samples")


def top_categories(error_types: DataFrame, classes: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k strata of error types and classes with most errors in each key; strata are few."""
    rows = error_types.select(*keys, F.col("error_type").alias("category"), F.lit("error_type").alias("type"), "total_errors").unionByName(classes.select(*keys, F.col("class_name").alias("category"), F.lit("class").alias("type"), "total_errors"))
    w = Window.partitionBy(*keys).orderBy(F.col("total_errors").desc(), "category")
    return rows.where("total_errors > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_examples(failures: DataFrame, k: int, focus: str, multiclass: bool = True, by: list[str] | None = None) -> DataFrame:
    """The hardest samples by rate, by count, with the focus class, and by error type; for each key in ``by``."""
    lists = [R.top_k(failures, k, by=by), R.top_k(failures, k, "error_count", by=by), R.top_k(failures, k, error_type="class_confusion", by=by)]
    if multiclass:
        lists.append(R.top_k(failures, k, class_name=focus, by=by))
    return reduce(lambda a, b: a.unionByName(b), lists)


def measurability(spark, only: str | None = None, masks: bool = False, probabilities: bool = False) -> DataFrame:
    """The categories and whether they can be measured: by class maps alone, with ``masks`` (pixels that have places), with ``probabilities``."""
    known = {"deferred": masks, "not_measurable": probabilities}
    table = spark.createDataFrame([(c, "measurable" if known.get(m) else m) for c, m in TAXONOMY], "category string, measurability string")
    return table if only is None else table.where(F.col("measurability") == only)


def limitations(models: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, topic, text): what class maps cannot tell of each model, and of one without failing samples, that these were not analysed."""
    why = {"deferred": "DEFERRED (needs spatial mask analysis).", "not_measurable": "NOT MEASURABLE (needs predicted probabilities/confidence)."}
    lines = [("real_data", "Real-data failure statistics: NOT YET MEASURED (synthetic inputs only)."), *[(c, f"{c}: {why[m]}") for c, m in TAXONOMY if m in why]]
    none = models.join(failures.select(*keys).distinct(), keys, "left_anti")
    none = none.select(*keys, F.lit("samples").alias("topic"), F.lit("Sample-level analysis: not available (no per-sample predictions provided).").alias("text"))
    return models.crossJoin(F.broadcast(models.sparkSession.createDataFrame(lines, "topic string, text string"))).unionByName(none)


def measured_counts(samples: DataFrame, spatial: DataFrame, confidence: DataFrame) -> DataFrame:
    """(category, cases) of all categories: failing samples of ``sample_failures``, images of ``spatial_failures``, rows of ``confidence_errors``."""
    by = lambda rows: rows.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("cases"))
    kinds = ("high_confidence_error", "low_confidence_error")
    sums = confidence.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("cases")) for k in kinds])).alias("k")).groupBy("k.category").agg(F.sum("k.cases").alias("cases"))
    found = by(samples).unionByName(by(spatial)).unionByName(sums)
    every = measurability(samples.sparkSession, "measurable", masks=True, probabilities=True)
    return every.join(F.broadcast(found), "category", "left").select("category", F.coalesce("cases", F.lit(0)).alias("cases"))  # a row for each category
