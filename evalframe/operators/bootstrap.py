"""Confidence intervals of metrics by a Poisson bootstrap over samples, in one pass over their confusion cells.

Each replicate draws every sample as often as a Poisson number of mean 1 says that
is a function of the sample's id and the replicate alone: nothing is drawn at random
at run time, so that intervals are the same however the input is arranged and whatever
task computes it twice. A sample's rows are counted first (at most classes squared for
each key and stratum); its counts are then added to sums of 40 replicates at once, which
are columns, so that replicates do not multiply rows. What is shuffled and computed after
that are tables of classes squared for each key, stratum and replicate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators import confusion as C
from evalframe.sources.shared import checkpointed

REPLICATES, LEVEL = 200, 0.95
#: Replicates that one digest serves, with 32 bits each.
PER_DIGEST = 8
#: Digests that one row is multiplied by at once, so that 40 replicates are columns of one row.
PER_ROW = 5


def poisson_bounds(most: int = 12) -> list[int]:
    """From which 32-bit numbers on a Poisson number of mean 1 is at least 1, 2, ..., ``most``."""
    below = [sum(math.exp(-1) / math.factorial(i) for i in range(k)) for k in range(1, most + 1)]
    return [b for b in (math.ceil(p * 2**32) for p in below) if b < 2**32]


def _digest(sample: Column, block: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), sample.cast("string"), block.cast("string")), 256)


def _weight(digest: Column, i: Column) -> Column:
    """The Poisson number of the digest's ``i``-th 32 bits. Hexadecimal digits of one length are ordered as their numbers are; small weights, which are most, come first."""
    number, cases = F.substring(digest, i * 8 + 1, F.lit(8)), F
    for k, b in enumerate(poisson_bounds()):
        cases = cases.when(number < f"{b:08x}", k)
    return cases.otherwise(len(poisson_bounds()))


def replicate_weights(samples: DataFrame, sample: str, replicates: int, seed: int = 0) -> DataFrame:
    """The rows with ``replicate`` (from 0) and ``weight``, without those whose weight is 0."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // PER_DIGEST) - 1))).alias("_block")
    rows = samples.select("*", blocks).withColumn("_digest", _digest(F.col(sample), F.col("_block"), seed))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(PER_DIGEST - 1))).alias("_i"))
    out = rows.withColumns({"replicate": F.col("_block") * PER_DIGEST + F.col("_i"), "weight": _weight(F.col("_digest"), F.col("_i"))})
    return out.where((F.col("weight") > 0) & (F.col("replicate") < replicates)).drop("_block", "_digest", "_i")


def replicated_confusion(rows: DataFrame, keys: list[str], sample: str = "sample_id", replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(*keys, replicate, true_class, pred_class, n): the confusion table of each replicate, and as replicate -1 that of the rows as they are.

    ``rows``: keys, sample, true_class, pred_class. The small table is written once, since all metrics read it.
    """
    blocks = -(-replicates // PER_DIGEST)
    cells = rows.groupBy(*keys, sample, "true_class", "pred_class").agg(F.count("*").alias("n"))
    group = F.explode(F.array(*map(F.lit, range(0, blocks, PER_ROW)))).alias("_g")  # the first of the blocks that a row takes
    digests = {f"_d{j}": _digest(F.col(sample), F.col("_g") + j, seed) for j in range(min(blocks, PER_ROW))}
    sums = [F.sum(F.col("n") * _weight(F.col(d), F.lit(i))) for d in digests for i in range(PER_DIGEST)]
    counted = cells.select("*", group).withColumns(digests).groupBy(*keys, "_g", "true_class", "pred_class").agg(F.sum("n").alias("_n"), F.array(*sums).alias("_s"))
    first = F.col("_g") * PER_DIGEST
    drawn = F.transform("_s", lambda s, i: F.struct((first + i).alias("replicate"), s.alias("n")))
    whole = F.array(F.struct(F.lit(-1).alias("replicate"), F.col("_n").alias("n")))
    out = counted.select(*keys, "true_class", "pred_class", F.inline(F.when(F.col("_g") == 0, F.concat(whole, drawn)).otherwise(drawn)))
    return checkpointed(out.where((F.col("n") > 0) & (F.col("replicate") < replicates)).select(*keys, "replicate", "true_class", "pred_class", "n"))


def _mean(column: str) -> Column:
    """The mean over classes of what is not null, added up in the order of classes, so that its last digit is always the same."""
    values = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("class_index", column))), lambda s: s[column]), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def _long(table: DataFrame, keys: list[str], classes: DataFrame) -> DataFrame:
    """(*keys, class_name, metric, value) of all class metrics, and accuracy and macro means as those of class ``__all__``."""
    m = C.class_metrics(C.class_counts(table, keys, classes))
    pairs = lambda names: F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")
    each = m.select(*keys, "class_name", pairs(C.METRICS)).select(*keys, "class_name", "m.*")
    macro = m.groupBy(*keys).agg(*[_mean(c).alias(c) for c in C.METRICS]).join(C.pixel_accuracy(table, keys), keys)
    whole = macro.select(*keys, F.lit("__all__").alias("class_name"), pairs([*C.METRICS, "accuracy"])).select(*keys, "class_name", "m.*")
    return each.unionByName(whole)


def _spread(table: DataFrame, value: str, names: list[str], level: float) -> DataFrame:
    """(*names, ``value``, low, high, defined) of values by replicate, of which -1 is that of the rows as they are."""
    tail, drawn = (1 - level) / 2, F.when(F.col("replicate") >= 0, F.col(value))
    aggs = [F.max(F.when(F.col("replicate") == -1, F.col(value))).alias(value), F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.count(drawn).alias("defined")]
    return table.groupBy(*names).agg(*aggs).select(*names, value, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "defined")


def metric_intervals(rows: DataFrame, keys: list[str], group: str | None, classes: DataFrame, sample: str = "sample_id", replicates: int = REPLICATES, level: float = LEVEL, seed: int = 0) -> DataFrame:
    """(stratum, *keys, class_name, metric, value, low, high, defined): each metric with its percentile interval.

    ``group``: the column of strata, besides which ``__overall__`` has all rows; None leaves strata out. ``value`` is that of the
    rows as they are, ``defined`` the number of replicates in which the metric is defined; undefined ones play no part, and
    without any the interval is null. Samples are drawn whole, with their rows of all keys and strata. A null sample is one sample.
    """
    table = replicated_confusion(rows, [*keys, *([group] if group else [])], sample, replicates, seed)
    by = list(dict.fromkeys(("stratum", *keys))) if group else keys
    if group:
        table = C.strata(table, group, [*keys, "replicate"])
    return _spread(_long(table, [*by, "replicate"], classes), "value", [*by, "class_name", "metric"], level)


def paired_intervals(rows: DataFrame, arm: str, arms: tuple[str, str], classes: DataFrame, sample: str = "sample_id", replicates: int = REPLICATES, level: float = LEVEL, seed: int = 0) -> DataFrame:
    """(class_name, metric, delta, low, high, defined): the second arm's metric less the first's.

    Both arms' rows of a sample are drawn together, so that the intervals are of the difference on the same samples.
    """
    table = _long(replicated_confusion(rows, [arm], sample, replicates, seed), [arm, "replicate"], classes)
    of = [F.max(F.when(F.col(arm) == a, F.col("value"))) for a in arms]
    deltas = table.groupBy("class_name", "metric", "replicate").agg((of[1] - of[0]).alias("delta"))
    return _spread(deltas, "delta", ["class_name", "metric"], level)
