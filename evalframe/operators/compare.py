"""Controlled comparison of models: deltas, fairness of controls, compute ratios, verdicts, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.vocab import IDENTITY_PATHS

METRICS = ("iou", "dice", "precision", "recall", "f1")


def delta(base: Column, new: Column) -> Column:
    """Rounded to six places before anything is decided by it; null if either is."""
    return F.round(new - base, 6)


def arm_join(base: DataFrame, new: DataFrame, keys: list[str], columns: tuple[str, ...] = METRICS) -> DataFrame:
    """Baseline rows with the other arm's values; null where the other arm has no such row."""
    b = base.select(*keys, *[F.col(c).alias(f"baseline_{c}") for c in columns])
    return b.join(new.select(*keys, *[F.col(c).alias(f"improved_{c}") for c in columns]), keys, "left")


def metric_deltas(base: DataFrame, new: DataFrame, keys: list[str], columns: tuple[str, ...] = METRICS) -> DataFrame:
    return arm_join(base, new, keys, columns).withColumns({f"{c}_delta": delta(F.col(f"baseline_{c}"), F.col(f"improved_{c}")) for c in columns})


def focus_delta(base: DataFrame, new: DataFrame, keys: list[str], focus: str) -> DataFrame:
    """Deltas of the focus class; regressed if IoU or Dice fell, null if both are undefined."""
    own = [d.where(F.col("class_name") == focus) for d in (base, new)]
    d = metric_deltas(*own, keys, ("iou", "dice", "recall", "fn"))
    i, j = F.col("iou_delta"), F.col("dice_delta")
    regressed = F.when(i.isNotNull() | j.isNotNull(), F.coalesce(i < 0, F.lit(False)) | F.coalesce(j < 0, F.lit(False)))
    return d.withColumn("regressed", regressed)


def failure_deltas(base: DataFrame, new: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Changes of failures; the hypothesis is judged only on measured results."""
    d = metric_deltas(base, new, keys, ("focus_failures", "total_failures", "false_negatives"))
    supported = (F.col("focus_failures_delta") < 0) & (F.col("improved_false_negatives") <= F.col("baseline_false_negatives"))
    return d.withColumn("hypothesis_supported", F.when(F.lit(status == "MEASURED"), supported))


def ratio(base: Column, new: Column) -> Column:
    return F.round(F.try_divide(new.cast("double"), base), 6)


def compute_ratios(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios of parameters and times, the parameter delta, and the better of the two measurement states."""
    d = arm_join(base, new, keys, ("parameters", "train_seconds", "infer_seconds", "status"))
    both = F.array("baseline_status", "improved_status")
    status = F.when(F.array_contains(both, "MEASURED"), "MEASURED").when(F.array_contains(both, "SYNTHETIC"), "SYNTHETIC").otherwise("NOT_MEASURED")
    return d.select(
        *keys,
        ratio(F.col("baseline_parameters"), F.col("improved_parameters")).alias("parameter_ratio"),
        (F.col("improved_parameters") - F.col("baseline_parameters")).alias("parameter_delta"),
        ratio(F.col("baseline_train_seconds"), F.col("improved_train_seconds")).alias("train_ratio"),
        ratio(F.col("baseline_infer_seconds"), F.col("improved_infer_seconds")).alias("infer_ratio"),
        status.alias("status"),
    )


def delta_vs_baseline(models: DataFrame, keys: list[str], baseline: str, column: str) -> DataFrame:
    """Each model's value less the baseline's; null without a baseline."""
    b = models.where(F.col("model_id") == baseline).select(*keys, F.col(column).alias("_base"))
    joined = models.join(b, keys, "left") if keys else models.join(F.broadcast(b.limit(1)), F.lit(True), "left")
    return joined.withColumn(f"{column}_delta", F.col(column) - F.col("_base")).drop("_base")


def shared_controls(controls: DataFrame, identity: tuple[str, ...] = IDENTITY_PATHS) -> DataFrame:
    """Controls without the paths that tell arms apart."""
    gone = controls.sparkSession.createDataFrame([(p,) for p in identity], "path string")
    return controls.join(F.broadcast(gone), "path", "left_anti")


def fairness(base: DataFrame, new: DataFrame) -> DataFrame:
    """Every control path with both values and whether they match; a path that one arm lacks does not, unless null there."""
    j = base.select("path", F.col("value").alias("baseline")).join(new.select("path", F.col("value").alias("improved")), "path", "full")
    return j.withColumn("matches", F.col("baseline").eqNullSafe(F.col("improved")))


def is_fair(report: DataFrame, base_hash: Column, new_hash: Column) -> DataFrame:
    """Fair if all controls match and the models differ."""
    return report.agg(F.coalesce(F.bool_and("matches"), F.lit(True)).alias("all_match")).select((F.col("all_match") & (base_hash != new_hash)).alias("fair"))


#: Tolerances of a decision.
THRESHOLDS = {"focus": 0.01, "macro": 0.01, "regression": 0.01, "cost": 1.5, "small_gain": 0.03, "seeds": 3}


def decide(rows: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Adds ``outcome`` and ``rationale``, in order of precedence.

    ``rows``: data_regime, status, focus_delta, macro_delta, worst_delta, regressed, parameter_ratio, train_ratio, seeds.
    """
    th = thresholds
    f, m, w = F.col("focus_delta"), F.col("macro_delta"), F.col("worst_delta")
    unreal = (F.col("data_regime") != "REAL") | (F.col("status") != "MEASURED")
    undefined = f.isNull() | m.isNull()
    unseeded = F.col("seeds") < 1
    fell = (f <= -th["regression"]) | F.coalesce("regressed", F.lit(False)) | F.coalesce(w <= -th["regression"], F.lit(False))
    gained = (f >= th["focus"]) & (m >= -th["macro"])
    costly = F.coalesce(F.col("parameter_ratio") > th["cost"], F.lit(False)) | F.coalesce(F.col("train_ratio") > th["cost"], F.lit(False))
    outcome = (
        F.when(unreal | undefined | unseeded, "INCONCLUSIVE").when(fell, "REGRESSION")
        .when(gained & costly & (f < th["small_gain"]), "COMPUTE_UNJUSTIFIED").when(gained, "IMPROVED").otherwise("NO_SIGNIFICANT_IMPROVEMENT")
    )
    judged = ~(unreal | undefined | unseeded)
    rationale = F.array_compact(F.array(
        F.when(unreal, "results are not real measurements"),
        F.when(~unreal & undefined, "a delta is undefined"),
        F.when(~unreal & ~undefined & unseeded, "no seeds were run"),
        F.when(judged, F.format_string("focus delta %+.4f", f)),
        F.when(judged, F.format_string("macro delta %+.4f", m)),
        F.when(judged & (F.col("seeds") < th["seeds"]), "too few seeds for significance"),
        F.when(judged & fell & (m > 0), "the aggregate gained while a difficult class fell"),
    ))
    return rows.withColumns({"outcome": outcome, "rationale": rationale})


def row_digest(columns: list[str]) -> Column:
    """A row's content as hex: its columns by name, each value behind its length, so that no two rows read alike.

    A null has no length, and so differs from every value.
    """
    values = [(c, F.col(c).cast("string")) for c in sorted(columns)]
    parts = [F.concat(F.lit(c + "="), F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("null"))) for c, v in values]
    return F.sha2(F.concat_ws("|", *parts), 256)


def fingerprint(df: DataFrame, keys: list[str] | None = None, ignore: tuple[str, ...] = ("created_at", "notes")) -> DataFrame:
    """A content hash that depends neither on the order nor on the arrangement of rows.

    It is a digest of the number of rows and the exact sums of 60-bit parts of their digests, so repeated rows count.
    """
    keys = keys or []
    cols = [c for c in df.columns if c not in ignore and c not in keys]
    d = df.withColumn("_d", row_digest(cols))
    sums = [F.sum(F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(2)]
    return d.groupBy(*keys).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("fingerprint"), F.count("*").alias("rows"))


def artifact_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def sections(**tables: DataFrame) -> DataFrame:
    """All tables of a report as one, with the union of their columns."""
    named = [df.select(F.lit(name).alias("section"), *df.columns) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
