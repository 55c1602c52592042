"""Composite jobs: what a user runs on whole tables, built from the operators.

Each returns lazily composed DataFrames; nothing is collected. Tables of
predictions have keys, ``sample_id``, ``group_id``, ``true_class``, ``pred_class``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.operators import compare as M
from evalframe.operators import confusion as C
from evalframe.operators import failures as E
from evalframe.operators import quality as Q
from evalframe.operators import ranking as R


@dataclass(frozen=True)
class Evaluation:
    """Counts, class metrics, aggregates and strata of each model."""

    confusion: DataFrame
    classes: DataFrame
    macro: DataFrame
    micro: DataFrame
    weighted: DataFrame
    strata: DataFrame
    summary: DataFrame


def evaluate(predictions: DataFrame, classes: DataFrame, focus: str, ignore: int | None = None) -> Evaluation:
    """One full-size shuffle by (model, group, true, predicted); all else is on its small result."""
    fine = C.confusion(predictions, ["model_id", "group_id"], ignore=ignore)
    whole = fine.groupBy("model_id", "true_class", "pred_class").agg(F.sum("n").alias("n"))
    counts = C.class_counts(whole, ["model_id"], classes)
    metrics = C.class_metrics(counts)
    strata = C.strata(fine, "group_id", ["model_id"])
    return Evaluation(whole, metrics, C.macro(metrics, ["model_id"]), C.micro(counts, ["model_id"]), C.weighted(metrics, ["model_id"]), stratum_metrics(strata, classes), C.summary(whole, ["model_id"], classes, focus))


def stratum_metrics(strata: DataFrame, classes: DataFrame) -> DataFrame:
    return C.class_metrics(C.class_counts(strata, ["model_id", "stratum"], classes))


@dataclass(frozen=True)
class FailureAnalysis:
    """Error records of classes, failing samples with their ranks, hard examples and summaries."""

    records: DataFrame
    samples: DataFrame
    ranked: DataFrame
    hard: DataFrame
    by_class: DataFrame
    by_type: DataFrame
    by_group: DataFrame
    arms: DataFrame


def analyze_failures(predictions: DataFrame, classes: DataFrame, names: dict[int, str], focus: str, model: str, k: int = 20, multiclass: bool = True, ignore: int | None = None) -> FailureAnalysis:
    """All models' records and summaries; ranks and hard examples of one. Samples without errors are not failures."""
    keys = ["model_id"]
    table = C.confusion(predictions, keys, ignore=ignore)
    records = E.error_records(table, C.class_counts(table, keys, classes), keys, classes)
    samples = E.failing(E.sample_failures(predictions, keys, names, multiclass, ignore))
    own = samples.where(F.col("model_id") == model)
    return FailureAnalysis(
        records, samples, R.rank_samples(own), E.hard_examples(own, k, focus, multiclass), E.class_summary(records, samples, keys, classes),
        E.error_type_summary(records, samples, keys), E.group_summary(samples, keys), E.arm_summary(records, samples, keys, focus),
    )


def compare_models(metrics: DataFrame, compute: DataFrame, baseline: str, candidates: list[str], focus: str, seeds: int, data_regime: str = "REAL", status: str = "MEASURED") -> DataFrame:
    """Deltas, cost and verdict of each candidate against the baseline, for every stratum.

    ``metrics``: class metrics by model and stratum; ``compute``: parameters, train_seconds, infer_seconds, status by both.
    """
    keys = ["stratum", "class_name"]
    base = metrics.where(F.col("model_id") == baseline).drop("model_id")
    cost = compute.where(F.col("model_id") == baseline).drop("model_id")
    out = None
    for c in candidates:
        new, new_cost = metrics.where(F.col("model_id") == c).drop("model_id"), compute.where(F.col("model_id") == c).drop("model_id")
        d = M.metric_deltas(base, new, keys).join(base.select(*keys, "class_index"), keys)
        worst = F.min_by(F.col("iou_delta"), F.when(F.col("baseline_iou").isNotNull(), F.struct("baseline_iou", "class_index")))
        macro = d.groupBy("stratum").agg(M.delta(F.avg("baseline_iou"), F.avg("improved_iou")).alias("macro_delta"), worst.alias("worst_delta"))
        f = M.focus_delta(base, new, keys, focus).select("stratum", F.col("iou_delta").alias("focus_delta"), "regressed")
        ratios = M.compute_ratios(cost, new_cost, ["stratum"]).select("stratum", "parameter_ratio", "train_ratio")
        rows = f.join(macro, "stratum").join(ratios, "stratum", "left")
        rows = rows.withColumns({"candidate": F.lit(c), "seeds": F.lit(seeds), "data_regime": F.lit(data_regime), "status": F.lit(status)})
        out = M.decide(rows) if out is None else out.unionByName(M.decide(rows))
    return out


@dataclass(frozen=True)
class Prepared:
    """Issues, splits, leaks, dataset states and readiness."""

    issues: DataFrame
    splits: DataFrame
    leaks: DataFrame
    status: DataFrame


def prepare_dataset(samples: DataFrame, sample_files: DataFrame, files: DataFrame, meta: DataFrame, expected: DataFrame, labels: DataFrame, num_classes: int, required: list[int], bands: int, group: str = "group_id", seed: int = 42) -> Prepared:
    """Validation, grouped splits with their leakage check, and the state of each dataset."""
    splits = R.split_groups(samples, group, seed)
    return Prepared(
        Q.validate_samples(samples, sample_files, files, meta, bands), splits, R.leakage(splits, group), Q.dataset_status(sample_files, files, expected, labels, num_classes, required, bands),
    )
