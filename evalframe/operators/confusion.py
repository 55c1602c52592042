"""Confusion counts and the metrics derived from them.

A confusion table is long: key columns, ``true_class``, ``pred_class``, ``n``.
Undefined metrics are null, never zero. All work after the first aggregation is
on tables of classes squared rows for each key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("iou", "dice", "precision", "recall", "f1")


def drop_ignored(rows: DataFrame, ignore: int | None) -> DataFrame:
    """Rows whose target is the ignore label go; predictions are not looked at."""
    return rows if ignore is None else rows.where(F.col("true_class") != ignore)


def label_violations(rows: DataFrame, num_classes: int, ignore: int | None = None) -> DataFrame:
    """Rows with a class outside 0..num_classes-1, after the ignore label has gone."""
    bad = [(F.col(c) < 0) | (F.col(c) >= num_classes) | F.col(c).isNull() for c in ("true_class", "pred_class")]
    return drop_ignored(rows, ignore).where(bad[0] | bad[1])


def confusion(rows: DataFrame, keys: list[str], num_classes: int | None = None, ignore: int | None = None) -> DataFrame:
    """Counts for each key, true and predicted class. With ``num_classes``, a class out of range fails the job."""
    rows = drop_ignored(rows, ignore)
    if num_classes is not None:
        ok = reduce(lambda a, b: a & b, [F.col(c).between(0, num_classes - 1) for c in ("true_class", "pred_class")])
        rows = rows.where(F.coalesce(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("class out of range")).isNull(), F.lit(True)))
    return rows.groupBy(*keys, "true_class", "pred_class").agg(F.count("*").alias("n"))


def merge(*tables: DataFrame) -> DataFrame:
    """The sum of confusion tables with the same columns."""
    if len({tuple(sorted(t.columns)) for t in tables}) > 1:
        raise ValueError("confusion tables have different keys")
    union = reduce(lambda a, b: a.unionByName(b), tables)
    return union.groupBy(*[c for c in union.columns if c != "n"]).agg(F.sum("n").alias("n"))


def scaffold(table: DataFrame, keys: list[str], classes: DataFrame) -> DataFrame:
    """Every pair of classes for every key, zero where there is no count. ``classes``: the few class_index rows."""
    k = table.select(*keys).distinct()
    small = classes.select("class_index")
    cells = k.crossJoin(F.broadcast(small.select(F.col("class_index").alias("true_class")))).crossJoin(F.broadcast(small.select(F.col("class_index").alias("pred_class"))))
    return cells.join(table, [*keys, "true_class", "pred_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_counts(table: DataFrame, keys: list[str], classes: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, support, predicted and total of every class for every key."""
    by_true = table.groupBy(*keys, F.col("true_class").alias("class_index")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = table.groupBy(*keys, F.col("pred_class").alias("class_index")).agg(F.sum("n").alias("predicted"))
    total = table.groupBy(*keys).agg(F.sum("n").alias("total"))
    rows = total.crossJoin(F.broadcast(classes)).join(by_true, [*keys, "class_index"], "left").join(by_pred, [*keys, "class_index"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("support", "tp", "predicted")})
    return rows.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp"), "tn": F.col("total") - F.col("support") - F.col("predicted") + F.col("tp")})


def metric_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """IoU, Dice, precision, recall and F1 from counts; null where a denominator is zero.

    F1 is undefined when precision or recall is, or when both are zero; Dice may then still be defined.
    """
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {"iou": F.try_divide(tp, tp + fp + fn), "dice": F.try_divide(2 * tp, 2 * tp + fp + fn), "precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)}


def class_metrics(counts: DataFrame) -> DataFrame:
    """Adds the metrics to class counts."""
    return counts.withColumns(metric_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def metric_rows(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each metric: value, defined, reason."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m")
    rows = metrics.select(*keys, pairs).select(*keys, "m.metric", "m.value")
    return rows.withColumns({"defined": F.col("value").isNotNull(), "reason": F.when(F.col("value").isNull(), "zero denominator").otherwise("")})


def pixel_accuracy(table: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0))
    return table.groupBy(*keys).agg(F.try_divide(hit, F.sum("n")).alias("accuracy"))


def macro(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the classes for which a metric is defined, with how many these are."""
    aggs = [a for m in METRICS for a in (F.avg(m).alias(m), F.concat_ws("/", F.count(m), F.count("*")).alias(f"{m}_classes"))]
    return metrics.groupBy(*keys).agg(*aggs)


def weighted(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Means weighted by support over the classes for which a metric is defined."""
    weight = {m: F.sum(F.when(F.col(m).isNotNull(), F.col("support"))) for m in METRICS}
    return metrics.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(m) * F.col("support")), weight[m]).alias(m) for m in METRICS])


def micro(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of the summed counts."""
    total = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return total.withColumns(metric_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def strata(table: DataFrame, group: str, keys: list[str], overall: str = "__overall__") -> DataFrame:
    """The counts of each group and of all together, from one small table: a ``stratum`` column instead of ``group``."""
    sets = table.groupingSets([[F.col(group), *map(F.col, keys), F.col("true_class"), F.col("pred_class")], [*map(F.col, keys), F.col("true_class"), F.col("pred_class")]], group, *keys, "true_class", "pred_class")
    out = sets.agg(F.sum("n").alias("n"), F.grouping(group).alias("all"))
    return out.select(F.when(F.col("all") == 1, overall).otherwise(F.coalesce(group, F.lit("_ungrouped"))).alias("stratum"), *keys, "true_class", "pred_class", "n")


def summary(table: DataFrame, keys: list[str], classes: DataFrame, focus: str) -> DataFrame:
    """Accuracy, macro IoU and F1, the focus class's IoU and the worst defined class (the lower index on ties)."""
    m = class_metrics(class_counts(table, keys, classes))
    worst = F.min_by("class_name", F.when(F.col("iou").isNotNull(), F.struct("iou", "class_index")))
    out = m.groupBy(*keys).agg(F.avg("iou").alias("macro_iou"), F.avg("f1").alias("macro_f1"), F.max(F.when(F.col("class_name") == focus, F.col("iou"))).alias("focus_iou"), worst.alias("worst_class"))
    return pixel_accuracy(table, keys).join(out, keys)


def class_view(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A map of class name to metrics for each key."""
    entry = F.struct("class_name", F.struct(*METRICS).alias("metrics"))
    return metrics.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("classes"))


def evaluate(rows: DataFrame, keys: list[str], classes: DataFrame, ignore: int | None = None) -> DataFrame:
    """Predictions to class metrics."""
    return class_metrics(class_counts(confusion(rows, keys, None, ignore), keys, classes))


def pivoted(table: DataFrame, keys: list[str], indices: list[int]) -> DataFrame:
    """One row for each key and true class, a column for each predicted class."""
    out = table.groupBy(*keys, "true_class").pivot("pred_class", indices).agg(F.sum("n"))
    return out.select(*keys, "true_class", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"pred_{i}") for i in indices])
