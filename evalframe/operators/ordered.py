"""Places and running sums in one order over a whole table, without sorting it in one task.

Rows are dealt to partitions by sampled ranges of the order, sorted there and written
with their place in the partition. One row for each partition then tells how much
comes before it. Rows that are equal in all order columns are split as well: their
place in the input is the last of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.sources.shared import checkpointed

_PLACE_BITS = 33  # monotonically_increasing_id has the partition above the place in it


def arranged(rows: DataFrame, order: list[Column], partitions: int | None = None, written: bool = False) -> DataFrame:
    """The rows with ``_part``, partitions in order, and ``_at``, the 0-based place in the partition.

    Rows that are not a ``written`` table are written first, so that their places in the input are the same whenever they are read.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows if written else checkpointed(rows)).withColumn("_tie", F.monotonically_increasing_id())
    placed = dealt.repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_id", F.monotonically_increasing_id())
    part, at = F.shiftright("_id", _PLACE_BITS), F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return checkpointed(placed.withColumns({"_part": part.cast("int"), "_at": at}).drop("_tie", "_id"))


def _before(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each partition the sums over all earlier ones: a row for each partition."""
    totals = placed.groupBy("_part").agg(*[s.alias(f"_t_{n}") for n, s in sums.items()])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])


def with_positions(rows: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None, written: bool = False, by: list[str] | None = None) -> DataFrame:
    """1-based place of each row in the whole order, or among the rows that are alike in ``by``."""
    by = by or []
    placed = arranged(rows, [*map(F.col, by), *order], partitions, written)
    offsets = F.broadcast(_before(placed, {"n": F.count("*")}))  # as many rows as partitions
    out = placed.join(offsets, "_part").withColumn(name, F.col("_b_n") + F.col("_at") + 1)
    if by:
        # where each key begins: a row for each key in each partition, at most as many of a key as partitions. Rows meet these by
        # partition and key, so that rows that share a key stay spread.
        keys = [f"_k_{k}" for k in by]
        ends = out.groupBy(F.col("_part").alias("_k"), *[F.col(k).alias(n) for k, n in zip(by, keys)]).agg(F.min(name).alias("_first"))
        first = ends.withColumn("_first", F.min("_first").over(Window.partitionBy(*keys)))
        same = [F.col("_part") == F.col("_k"), *[F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, keys)]]
        out = out.join(first, same).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first", "_k", *keys)
    return out.drop("_part", "_at", "_b_n")


def with_prefix_sums(rows: DataFrame, order: list[Column], columns: list[str], partitions: int | None = None, written: bool = False) -> DataFrame:
    """For each of ``columns`` its sum over all rows that come before, as ``<column>_before``; exact for whole numbers."""
    placed = arranged(rows, order, partitions, written)
    offsets = F.broadcast(_before(placed, {c: F.sum(c) for c in columns}))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in columns])
    out = own.join(offsets, "_part").withColumns({f"{c}_before": F.col(f"_i_{c}") + F.col(f"_b_{c}") for c in columns})
    return out.drop("_part", "_at", *[f"_{k}_{c}" for c in columns for k in "ib"])
