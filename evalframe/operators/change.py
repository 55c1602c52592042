"""Bi-temporal change: as-of pairs of acquisitions, transition matrices, errors of change that come from errors of masks.

An as-of pair is found without a range join: both sides are put in one order of
time, and the last row of the right side is carried forward. Groups are cut into
buckets of time, so that a tile that very many rows share is spread over tasks; what
is carried into a bucket comes from a table with one row for each group and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, carry: list[str], bucket: float, shift: float = 0, tolerance: float | None = None, prefix: str = "before_") -> DataFrame:
    """Each left row with ``at`` and ``carry`` of the last right row of its group at or before its time less ``shift``.

    ``at`` is a number. Of right rows at one time the one with the greatest ``carry`` counts. Left rows without such a row,
    or with none in ``tolerance`` before that time, have nulls; so have those whose group or time is null. ``bucket``:
    the time that one task holds of a group, at most.
    """
    side = F.struct(F.col(at).alias("at"), *carry)
    ours = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    theirs = right.dropna(subset=[*by, at]).select(*by, (F.col(at) + shift).alias("_at"), F.lit(0).alias("_side"), side.alias("_from"))
    rows = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / bucket))
    group = Window.partitionBy(*by, "_bucket")
    own = F.last("_from", ignorenulls=True).over(group.orderBy("_at", "_side", "_from").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a row for each group and bucket: the last row of it, and of the buckets before it
    ends = rows.groupBy(*by, "_bucket").agg(F.max_by("_from", F.when(F.col("_from").isNotNull(), F.struct("_at", "_from"))).alias("_end"))
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    into = ends.select(*by, F.col("_bucket"), earlier.alias("_into"))
    found = rows.withColumn("_own", own).where("_side = 1").join(into, [*by, "_bucket"], "left").withColumn("_from", F.coalesce("_own", "_into"))
    if tolerance is not None:
        found = found.withColumn("_from", F.when(F.col("_at") - shift - F.col("_from.at") <= tolerance, F.col("_from")))
    return found.select("_row.*", F.col("_from.at").alias(f"{prefix}{at}"), *[F.col(f"_from.{c}").alias(f"{prefix}{c}") for c in carry])


def change_pairs(acquisitions: DataFrame, tile: str, at: str, classes: list[str], bucket: float, gap: float = 1, tolerance: float | None = None) -> DataFrame:
    """Each acquisition of a tile with the last one at least ``gap`` before it; those that have none go. One row for each tile and time."""
    pairs = as_of(acquisitions, acquisitions, [tile], at, classes, bucket, gap, tolerance)
    return pairs.where(F.col(f"before_{at}").isNotNull())


def transitions(pairs: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(*keys, from_class, to_class, n, share): how often a class became another, and the share of what it became."""
    n = pairs.groupBy(*keys, F.col(f"before_{column}").alias("from_class"), F.col(column).alias("to_class")).agg(F.count("*").alias("n"))
    whole = n.groupBy(*keys, "from_class").agg(F.sum("n").alias("_all"))  # classes only
    return n.join(whole, [*keys, "from_class"]).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def _changed(column: str) -> Column:
    return F.col(column) != F.col(f"before_{column}")


def change_errors(pairs: DataFrame, keys: list[str], true: str, pred: str) -> DataFrame:
    """(*keys, wrong_masks, n, tp, fp, fn, tn): change that is found in predicted classes against change in true ones.

    ``wrong_masks``: in how many of the two acquisitions (0 to 2) the predicted class is wrong. With none wrong there is no
    error of change; what there is with one or two is what errors of masks make of it.
    """
    wrong = sum(((F.col(p + true) != F.col(p + pred)).cast("int") for p in ("", "before_")), F.lit(0))
    real, found = _changed(true), _changed(pred)
    cells = {"tp": real & found, "fp": ~real & found, "fn": real & ~found, "tn": ~real & ~found}
    return pairs.groupBy(*keys, wrong.alias("wrong_masks")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in cells.items()])
