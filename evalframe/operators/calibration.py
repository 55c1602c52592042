"""Confidence of predictions: reliability histograms, calibration errors, exact AUC, errors of high and low confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.exprs import argmax
from evalframe.operators.ordered import with_prefix_sums
from evalframe.operators.training_log import as_double, log_sum_exp

#: Probabilities have so many digits, so that they compare alike wherever they are computed.
DIGITS = 9
BINS = 10


def probabilities(logits: str, temperature: float = 1.0) -> Column:
    """The softmax of logits divided by a temperature."""
    x = F.transform(as_double(logits), lambda v: v / temperature)
    z = log_sum_exp(x)
    return F.transform(x, lambda v: F.round(F.exp(v - z), DIGITS))


def confident(rows: DataFrame, logits: str = "logits", label: str = "label", temperature: float = 1.0) -> DataFrame:
    """Adds the predicted class, its probability and whether it is right. Rows without logits or label go."""
    known = rows.where(F.col(logits).isNotNull() & F.col(label).isNotNull())
    out = known.withColumns({"predicted": argmax(F.col(logits)), "confidence": F.array_max(probabilities(logits, temperature))})
    return out.withColumn("correct", F.col("predicted") == F.col(label))


def reliability(rows: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """(keys, bin, n, confidence_sum, correct): counts by equal bins of confidence, in one aggregation; a confidence of 1 is in the last."""
    own = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, own.alias("bin")).agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence_sum"), F.count_if("correct").alias("correct"))


def merge_reliability(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The histogram of all rows behind several histograms with the same bins; ``keys`` may be fewer than theirs."""
    union = reduce(lambda a, b: a.unionByName(b), [t.select(*keys, "bin", "n", "confidence_sum", "correct") for t in tables])
    return union.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "confidence_sum", "correct")])


def calibration_error(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, accuracy, confidence, ece, mce): the mean and the largest gap between confidence and accuracy of the bins."""
    gap = F.abs(F.col("correct") - F.col("confidence_sum"))
    total = F.sum("n")
    return histogram.groupBy(*keys).agg(
        total.alias("n"), (F.sum("correct") / total).alias("accuracy"), (F.sum("confidence_sum") / total).alias("confidence"), (F.sum(gap) / total).alias("ece"), F.max(gap / F.col("n")).alias("mce"),
    )


def auc(rows: DataFrame, keys: list[str], score: str, positive: str, partitions: int | None = None) -> DataFrame:
    """(keys, positives, negatives, auc): the chance that a positive scores higher than a negative, ties counting half.

    Exact: rows are counted by score first, so that a score that very many rows share is one row, and the counts are
    summed in the order of keys and scores. Null where there are no positives or no negatives; null scores go.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(positive).alias("_pos"), F.count_if(~F.col(positive)).alias("_neg"))
    summed = with_prefix_sums(counts, [*map(F.col, keys), F.col("_s")], ["_neg"], partitions)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # twice the pairs won, over all earlier negatives; those of earlier keys are taken off at the end
    won = summed.groupBy(*keys).agg(F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), F.min("_neg_before").alias("_base"), F.sum(wide("_pos") * (2 * wide("_neg_before") + wide("_neg"))).alias("_won"))
    pairs = (F.col("_won") - 2 * wide("_base") * wide("positives")).cast("double")
    return won.select(*keys, "positives", "negatives", F.try_divide(pairs, 2.0 * F.col("positives") * F.col("negatives")).alias("auc"))


def class_scores(rows: DataFrame, logits: str = "logits", label: str = "label", temperature: float = 1.0) -> DataFrame:
    """(class_index, score, positive): a row for each row and class, for one class against the rest."""
    p = rows.where(F.col(logits).isNotNull() & F.col(label).isNotNull()).select(label, F.posexplode(probabilities(logits, temperature)).alias("class_index", "score"))
    return p.select("class_index", "score", (F.col("class_index") == F.col(label)).alias("positive"))


def confidence_errors(rows: DataFrame, keys: list[str], high: float, low: float) -> DataFrame:
    """(keys, n, errors, high_confidence_error, low_confidence_error): wrong rows, and those of them from ``high`` up and under ``low``."""
    wrong = ~F.col("correct")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(wrong).alias("errors"), F.count_if(wrong & (F.col("confidence") >= high)).alias("high_confidence_error"), F.count_if(wrong & (F.col("confidence") < low)).alias("low_confidence_error"),
    )
