"""Exact ranks, splits and subsets without sorting a large table in one task.

A rank is the number of rows in all earlier buckets or ranges plus the place in its
own. These are counted first; only their counts, a few thousand rows, are summed in
order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.exprs import severity_rank
from evalframe.functions.vocab import RATIOS, SEED
from evalframe.operators.ordered import with_positions


def bucketed_rank(df: DataFrame, bucket: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank by bucket (ascending), then by ``order`` inside it. Buckets must be few and order-preserving."""
    keys = [f"_b{i}" for i in range(len(bucket))]
    rows = df.withColumns(dict(zip(keys, bucket)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_in", inside).join(offsets, keys).withColumn(name, F.col("_before") + F.col("_in")).drop(*keys, "_in", "_before")


def canonical_order() -> list[Column]:
    """Severity, rate and count from high to low, then the id as text."""
    return [severity_rank(F.col("severity")).desc(), F.col("error_rate").desc(), F.col("error_count").desc(), F.col("sample_id").cast("string")]


def dedup_worst(failures: DataFrame, keys: list[str]) -> DataFrame:
    """The worst record of each sample."""
    w = Window.partitionBy(*keys).orderBy(*canonical_order())
    return failures.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rank_samples(failures: DataFrame, by: list[str] | None = None, partitions: int | None = None, written: bool = False) -> DataFrame:
    """Canonical rank of all failures, or of those alike in ``by``: dealt by ranges of the whole order, so that neither
    many equal values nor ids that begin alike meet in one task."""
    return with_positions(failures, canonical_order(), "rank", partitions, written, by)


def top_k(failures: DataFrame, k: int, criterion: str = "error_rate", class_name: str | None = None, error_type: str | None = None, by: list[str] | None = None) -> DataFrame:
    """The k hardest samples by rate or count, of those with a class among their errors or of an error type; for each key in ``by``.

    Spark keeps the k best of each task and key before it shuffles them.
    """
    pool, by = failures, by or []
    if class_name is not None:
        pool = pool.where(F.map_contains_key("per_class_errors", class_name) | (F.col("dominant_true_class") == class_name))
    if error_type is not None:
        pool = pool.where(F.array_contains("categories", error_type))
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(F.col(criterion).desc(), *canonical_order())
    ranked = pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*by, "sample_id", F.lit(class_name or error_type or criterion).alias("criterion"), F.col(criterion).cast("double").alias("value"), "rank", "severity")


def top_k_per_group(failures: DataFrame, group: str | list[str], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col("error_rate").desc(), *canonical_order())
    return failures.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_key(seed: int, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def shuffled(ids: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """1-based ``rank`` of distinct keys in a seeded order that does not depend on how the input is arranged."""
    h = ids.withColumn("_h", hash_key(seed, F.col(key)))
    return bucketed_rank(h, [F.substring("_h", 1, 3)], [F.col("_h"), F.col(key)]).drop("_h")


def split_flat(samples: DataFrame, key: str = "sample_id", seed: int = SEED, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """Splits with exact sizes: whole parts of val and test, the rest train. A repeated id fails the job."""
    if abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    ids = samples.groupBy(key).agg(F.count("*").alias("_n"))
    ids = ids.where(F.assert_true(F.col("_n") == 1, F.lit("duplicate ids")).isNull()).select(key)
    return _cut(ids, key, seed, ratios)


def _cut(ids: DataFrame, key: str, seed: int, ratios: dict[str, float]) -> DataFrame:
    total = ids.agg(F.count("*").alias("_total"))  # one row
    r = shuffled(ids, key, seed).crossJoin(F.broadcast(total))
    val, test = F.floor(F.col("_total") * ratios["val"]), F.floor(F.col("_total") * ratios["test"])
    split = F.when(F.col("rank") <= val, "val").when(F.col("rank") <= val + test, "test").otherwise("train")
    return r.select(key, split.alias("split"))


def split_groups(samples: DataFrame, group: str, seed: int = SEED, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """Splits of whole groups; the ratios are of groups. A sample without a group is its own."""
    g = F.coalesce(F.nullif(F.col(group), F.lit("")), F.col("sample_id").cast("string"))
    rows = samples.withColumn("_g", g)
    cut = _cut(rows.select("_g").distinct(), "_g", seed, ratios)
    return rows.join(cut, "_g").drop("_g")


def leakage(splits: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split, with how many."""
    return splits.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def split_overlaps(splits: DataFrame, key: str = "sample_id") -> DataFrame:
    """Keys in each pair of splits."""
    part = {s: splits.where(F.col("split") == s).select(key) for s in ("train", "val", "test")}
    out = None
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        both = part[a].intersect(part[b]).select(key, F.lit(a).alias("first"), F.lit(b).alias("second"))
        out = both if out is None else out.unionByName(both)
    return out


def curated_subset(samples: DataFrame, labels: DataFrame, required: list, budget: int, seed: int = SEED) -> DataFrame:
    """Ids that cover the required classes, then others in seeded order up to the budget.

    For each required class in turn, unless an id chosen before has it, the least id that has it is chosen, even
    beyond the budget. ``labels``: (sample_id, label) pairs. The driver sees one candidate for each required class,
    with the required classes that it has.
    """
    sets = labels.where(F.col("label").isin(required)).groupBy("sample_id").agg(F.collect_set("label").alias("has"))
    best = sets.select("sample_id", "has", F.explode("has").alias("label")).groupBy("label").agg(F.min(F.struct("sample_id", "has")).alias("best"))
    candidates = {r.label: r.best for r in best.collect()}  # at most as many rows as required classes
    forced, covered = [], set()
    for c in required:
        if c not in covered and c in candidates:
            forced.append(candidates[c].sample_id)
            covered |= set(candidates[c].has)
    rest = samples.select("sample_id").distinct()
    kind = samples.schema["sample_id"].dataType
    chosen = samples.sparkSession.createDataFrame([(x,) for x in forced], f"sample_id {kind.simpleString()}").withColumn("forced", F.lit(True))
    fill = shuffled(rest.join(F.broadcast(chosen), "sample_id", "left_anti"), "sample_id", seed).where(F.col("rank") <= max(0, budget - len(forced)))
    return chosen.unionByName(fill.select("sample_id", F.lit(False).alias("forced")))
