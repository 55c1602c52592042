"""Operators on metric logs and on losses of logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_so_far(log: DataFrame, run: str = "run_id", mode: str = "min") -> DataFrame:
    """The best value before each epoch, and whether the epoch strictly improves on it."""
    w = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = (F.min if mode == "min" else F.max)("value").over(w)
    better = F.col("value") < F.col("best_before") if mode == "min" else F.col("value") > F.col("best_before")
    return log.withColumn("best_before", best).withColumn("improved", F.coalesce(better, F.col("value").isNotNull()))


def early_stopping(log: DataFrame, patience: int, min_delta: float = 0.0, run: str = "run_id", mode: str = "min") -> DataFrame:
    """Best value and stop epoch of each run. The best moves only by more than ``min_delta``; the run stops once
    ``patience`` epochs have not moved it. A run's epochs are few and folded in order."""
    sign = 1.0 if mode == "min" else -1.0
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("wait"), F.lit(None).cast("int").alias("stop"))

    def step(s: Column, x: Column) -> Column:
        better = s.best.isNull() | (x["v"] < s.best - min_delta)
        moved = F.struct(x["v"].alias("best"), F.lit(0).alias("wait"), F.lit(None).cast("int").alias("stop"))
        waited = F.struct(s.best.alias("best"), (s.wait + 1).alias("wait"), F.when(s.wait + 1 >= patience, x["epoch"]).alias("stop"))
        return F.when(s.stop.isNotNull(), s).when(better, moved).otherwise(waited)

    steps = F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), (sign * F.col("value")).cast("double").alias("v"))))
    out = log.where("value is not null").groupBy(run).agg(steps.alias("steps")).withColumn("s", F.aggregate("steps", start, step))
    return out.select(run, (sign * F.col("s.best")).alias("best"), F.col("s.stop").alias("stop_epoch"), F.col("s.wait").alias("wait"))


def running_mean(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("running_mean", F.avg("value").over(w))


def run_summary(log: DataFrame, run: str = "run_id", mode: str = "min", stops: DataFrame | None = None) -> DataFrame:
    """Epochs, best value and its earliest epoch, last value, and whether the run stopped early."""
    key = F.struct("value", "epoch") if mode == "min" else F.struct(-F.col("value"), "epoch")
    best = F.min_by(F.struct("value", "epoch"), key)
    out = log.groupBy(run).agg(F.count("*").alias("epochs"), best.alias("b"), F.max_by("value", "epoch").alias("last_value"))
    out = out.select(run, "epochs", F.col("b.value").alias("best_value"), F.col("b.epoch").alias("best_epoch"), "last_value")
    if stops is not None:
        out = out.join(stops.select(run, F.col("stop_epoch").isNotNull().alias("stopped_early")), run, "left")
    return out


def log_sum_exp(logits: Column) -> Column:
    m = F.array_max(logits)
    return m + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - m)))


def as_double(logits: str) -> Column:
    return F.transform(logits, lambda x: x.cast("double"))


def cross_entropy(rows: DataFrame, weights: dict[int, float] | None = None, ignore: int = -100, keys: list[str] | None = None) -> DataFrame:
    """Mean of minus the log softmax at the label, by class weight if weights are given. Ignored labels play no part."""
    x = as_double("logits")
    nll = log_sum_exp(x) - F.element_at(x, F.col("label") + 1)
    w = F.lit(1.0) if not weights else F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("label")), F.lit(1.0))
    return rows.where(F.col("label") != ignore).select(*(keys or []), (w * nll).alias("l"), w.alias("w")).groupBy(*(keys or [])).agg(F.try_divide(F.sum("l"), F.sum("w")).alias("cross_entropy"))


def soft_dice(rows: DataFrame, smooth: float = 1.0) -> DataFrame:
    """One minus the mean over classes of (2 sum(p y) + s) / (sum p + sum y + s)."""
    x = as_double("logits")
    p = rows.withColumn("_z", log_sum_exp(x)).select("label", F.posexplode(F.transform(x, lambda v: F.exp(v - F.col("_z")))).alias("c", "p"))
    y = F.when(F.col("label") == F.col("c"), 1.0).otherwise(0.0)
    by = p.groupBy("c").agg(((2 * F.sum(F.col("p") * y) + smooth) / (F.sum("p") + F.sum(y) + smooth)).alias("dice"))
    return by.agg((1 - F.avg("dice")).alias("soft_dice"))


def dice_ce(rows: DataFrame) -> DataFrame:
    """Half of each loss; both are one row."""
    return cross_entropy(rows).crossJoin(F.broadcast(soft_dice(rows))).withColumn("dice_ce", 0.5 * F.col("cross_entropy") + 0.5 * F.col("soft_dice"))
