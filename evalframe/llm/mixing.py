"""Mixing sources to target weights (operator 4): hierarchical budgeting.

A tree of domain, language and source has the documents' tokens at its leaves.
A leaf can give its tokens as often as there are epochs; a node as much as its
children. The total budget goes down the tree by weights. A child that cannot
take its share takes what it has, and what it leaves goes to its siblings by
their weights; only what a whole subtree cannot take reaches its ancestors'
other children. Each leaf then gives the prefix of its budget from its epochs,
each of which has its documents in another seeded order.

Every level is a few rows per node; budgets are window expressions over a
node's children. Prefixes are sums over (leaf, epoch, bucket of the seeded
hash): buckets before the end are taken whole, the one that holds the end is
summed by smaller buckets in turn, and only what is left of that is put in order,
so no leaf's documents are sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.llm.common import cut, unused

#: Hex digits of the seeded hash that name a bucket, 4,096 to a leaf and epoch, and how often the last one is cut again.
DIGITS, CUTS = 3, 2
LEVELS = ("domain", "lang", "source")

#: The registered query's targets: weights of domains, and of languages in each; sources by their sizes.
TARGETS = (("web", None, 3), ("forum", None, 2), ("reference", None, 5), *((d, lang, w) for d in ("web", "forum", "reference") for lang, w in (("en", 4), ("de", 5), ("fr", 2), ("es", 1))))


def target_weights(spark: SparkSession) -> DataFrame:
    """TARGETS as a table of weights."""
    return spark.createDataFrame([(d, lang, None, w) for d, lang, w in TARGETS], "domain string, lang string, source string, weight long")


def hashed_domains(docs: DataFrame) -> DataFrame:
    """(source, domain) of every source: documents say nothing of domains, so sources are dealt to three by a digit of their hash."""
    digit = F.substring(F.md5("source"), 1, 1)
    domain = F.when(digit <= "8", "web").when(digit <= "c", "forum").otherwise("reference")
    return docs.where("source <> ''").select("source").distinct().withColumn("domain", domain)


def words(text: Column) -> Column:
    """Tokens as runs of characters other than white space (x20, x09 to x0D); 0 for null."""
    return F.when(F.length(F.trim(F.translate(text, "\t\n\u000b\f\r", "     "))) > 0, F.size(F.split(F.trim(F.translate(text, "\t\n\u000b\f\r", "     ")), " +"))).otherwise(0).cast("long")


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to children with ``capacity``, ``weight`` and their parent's ``given``: by weight, up to capacity.

    With children in order of capacity for each unit of weight, those that cannot take their share come
    first: child i is full if giving all children from i on the level of child i needs no more than is
    left after those before it. The rest share what is left by weight. A child without weight takes
    nothing unless all with weight are full.
    """
    w = Window.partitionBy(*parent).orderBy("ratio", *[c for c in LEVELS if c in children.columns])
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    c = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    c = c.withColumn("before", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("w_after", F.sum("weight").over(after))
    c = c.withColumn("full", (F.col("weight") > 0) & (F.col("ratio") * F.col("w_after") <= F.col("given") - F.col("before")))
    c = c.withColumn("taken", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole)).withColumn("w_left", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
    left = F.greatest(F.col("given") - F.col("taken"), F.lit(0))
    weighted = F.floor(left.cast("double") * F.col("weight") / F.col("w_left"))
    # children without weight are filled, in order, with what all others leave
    idle = F.least(F.col("capacity"), F.greatest(left - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.lit(None)).otherwise(F.col("capacity"))).over(before), F.lit(0)), F.lit(0)))
    budget = F.when(F.col("full"), F.col("capacity")).when(F.col("w_left") > 0, F.least(F.col("capacity"), weighted)).otherwise(idle)
    return c.withColumn("budget", budget.cast("long")).drop("ratio", "before", "w_after", "full", "taken", "w_left")


def leaf_budgets(leaves: DataFrame, total: int | None, epochs: int, weights: DataFrame | None = None) -> DataFrame:
    """Token budget of each leaf. ``leaves``: domain, lang, source, tokens. ``total`` None: all tokens, once.

    ``weights``: rows (domain, lang, source, weight), null below the node that a row is for. A node without
    a row weighs as the whole square root of its tokens, which favours small sources. Weights are integers,
    so that sums do not depend on their order.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    level = {3: leaves}
    for d in (2, 1):
        level[d] = leaves.groupBy(*LEVELS[:d]).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
    goal = F.sum("tokens").over(Window.partitionBy(F.lit(0))) if total is None else F.lit(total)
    given, root = None, F.floor(F.sqrt("tokens")).cast("long")
    for d in (1, 2, 3):
        own = level[d]
        if weights is None:
            own = own.withColumn("weight", root)
        else:
            deeper = [F.col(c).isNull() for c in LEVELS[d:]]
            rows = weights
            for x in [F.col(c).isNotNull() for c in LEVELS[:d]] + deeper:
                rows = rows.where(x)
            rows = rows.select(*LEVELS[:d], F.col("weight").cast("long").alias("set_weight"))
            own = own.join(rows, list(LEVELS[:d]), "left").withColumn("weight", F.coalesce("set_weight", root)).drop("set_weight")
        if given is None:
            # the domains are few; their sum is at most the goal and at most what there is
            top = own.withColumn("given", F.least(goal, F.sum("capacity").over(Window.partitionBy(F.lit(0)))))
            given = share_out(top.withColumn("root", F.lit(0)), ["root"]).drop("root")
        else:
            up = given.select(*LEVELS[: d - 1], F.col("budget").alias("given"))
            given = share_out(own.join(up, list(LEVELS[: d - 1])), list(LEVELS[: d - 1]))
    return given.select(*LEVELS, "tokens", "budget")


def prepared(docs: DataFrame, domains: DataFrame | None, tokens: Column | None) -> DataFrame:
    """Leaf, tokens and identity of every document. Null language or source: the empty string; no domain: ``web``."""
    t = words(F.col("text")) if tokens is None else tokens
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), t.cast("long").alias("n_tokens"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"))
    if domains is None:
        return rows.withColumn("domain", F.lit("web"))
    return rows.join(domains.select("source", F.col("domain")), "source", "left").withColumn("domain", F.coalesce("domain", F.lit("web")))


def mix(docs: DataFrame, total: int | None = None, epochs: int = 3, seed: int = 7, weights: DataFrame | None = None, domains: DataFrame | None = None, tokens: Column | None = None) -> DataFrame:
    """The selection: a row per document and epoch in which it is taken.

    Columns: doc_id, domain, lang, source, n_tokens, epoch (from 0), before (its leaf's tokens before it in
    the epoch's order; null where epoch or bucket is taken whole), budget (its leaf's), text_sha. ``domains`` has
    (source, domain), ``weights`` what ``leaf_budgets`` takes. A document is taken if it begins before the end of its
    leaf's budget, so a leaf may exceed it by one document. Documents without tokens come with the epoch's
    order like others. Rows equal in doc_id and text share a place. An empty table gives an empty result.
    """
    rows = cut(prepared(docs, domains, tokens))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = cut(leaf_budgets(leaves, total, epochs, weights))
    # whole epochs need no order; the last, partial one does
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    budgets = budgets.withColumn("whole", full).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    placed = rows.join(budgets.select(*LEVELS, "budget", "whole", "rest"), list(LEVELS))
    out = ["doc_id", *LEVELS, "n_tokens", "epoch", "before", "budget", "text_sha"]
    whole = placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).withColumn("before", F.lit(None).cast("long")).select(*out)
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string"), F.col("text_sha")), 256)
    left = placed.where("rest > 0").withColumn("epoch", F.col("whole")).withColumn("h", order).select(*LEVELS, "doc_id", "n_tokens", "epoch", "budget", "text_sha", "rest", "h", F.lit(0).cast("long").alias("gone"))
    taken = [whole]
    for depth in range(CUTS):
        dealt = left.withColumn("bucket", F.substring("h", 1 + depth * DIGITS, DIGITS))
        sums = dealt.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"))
        w = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.join(sums.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))), [*LEVELS, "bucket"])
        taken.append(dealt.where("base + n < rest").withColumn("before", F.lit(None).cast("long")).select(*out))
        left = dealt.where("base < rest and rest <= base + n").withColumns({"rest": F.col("rest") - F.col("base"), "gone": F.col("gone") + F.col("base")}).drop("bucket", "base", "n")
    inside = Window.partitionBy(*LEVELS).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ended = left.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens")).where("inside < rest")
    taken.append(ended.withColumn("before", F.col("gone") + F.col("inside")).select(*out))
    return reduce(DataFrame.unionByName, taken)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as it is taken, with their own columns, whatever their names.

    Options are those of ``mix``. Null and empty texts come with their leaf's epochs; rows equal in doc_id, leaf and
    text are taken together, as often each; an empty table gives an empty result.
    """
    d, lang, source, sha, domain, alike, times, n, copy, doc_id = unused(docs, "d", "lang", "source", "sha", "domain", "alike", "times", "n", "copy", "doc_id")
    taken = mix(docs, **options).groupBy("doc_id", *LEVELS, "text_sha").agg(F.count("*").alias(times))
    own = docs.withColumns({lang: F.coalesce("lang", F.lit("")), source: F.coalesce("source", F.lit("")), sha: F.sha2(F.coalesce("text", F.lit("")), 256)})
    domains = options.get("domains")
    if domains is None:
        own = own.withColumn(domain, F.lit("web"))
    else:
        own = own.join(domains.select(F.col("source").alias(source), F.col("domain").alias(d)), source, "left").withColumn(domain, F.coalesce(d, F.lit("web"))).drop(d)
    keys = [domain, lang, source, sha]
    counted = own.groupBy("doc_id", *keys).agg(F.count("*").alias(alike))
    taken = taken.select(F.col("doc_id").alias(doc_id), F.col("domain").alias(domain), F.col("lang").alias(lang), F.col("source").alias(source), F.col("text_sha").alias(sha), times)

    def same(a: DataFrame, b: DataFrame) -> Column:
        on = a["doc_id"].eqNullSafe(b[doc_id])
        for k in keys:
            on = on & (a[k] == b[k])
        return on

    counts = counted.join(taken, same(counted, taken)).select(doc_id, *[taken[k] for k in keys], F.floor(F.col(times) / F.col(alike)).cast("int").alias(n))
    joined = own.join(counts, same(own, counts))
    return joined.where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[own[c] for c in docs.columns])


def _share_sql(source: str, parent: str) -> str:
    over = f"PARTITION BY {parent} ORDER BY ratio, domain, lang, source"
    return f"""
SELECT *, CAST(CASE WHEN is_full THEN capacity
    WHEN w_left > 0 THEN least(capacity, floor(CAST(greatest(given - taken, 0) AS DOUBLE) * weight / w_left))
    ELSE least(capacity, greatest(given - taken - coalesce(idle, 0), 0)) END AS BIGINT) AS budget FROM (
  SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {parent}) AS taken,
         sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS w_left,
         sum(CASE WHEN weight > 0 THEN NULL ELSE capacity END) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS idle FROM (
    SELECT *, weight > 0 AND ratio * w_after <= given - before AS is_full FROM (
      SELECT *, coalesce(sum(capacity) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after FROM (
        SELECT *, CASE WHEN weight > 0 THEN capacity / weight ELSE CAST('inf' AS DOUBLE) END AS ratio FROM {source}))))"""


def oracle_sql(epochs: int = 3, seed: int = 7) -> str:
    """``mix`` with ``hashed_domains`` and ``TARGETS`` in DuckDB SQL."""
    rows = ", ".join(f"('{d}', {f"'{lang}'" if lang else 'NULL'}, {w})" for d, lang, w in TARGETS)
    digit = "substr(md5(source), 1, 1)"
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN coalesce(source, '') = '' OR {digit} <= '8' THEN 'web' WHEN {digit} <= 'c' THEN 'forum' ELSE 'reference' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, sha256(coalesce(text, '')) AS sha FROM documents),
t(domain, lang, weight) AS (VALUES {rows}),
l3 AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
l2 AS (SELECT domain, lang, '' AS source, CAST(sum(tokens) AS BIGINT) AS tokens FROM l3 GROUP BY ALL),
l1 AS (SELECT domain, '' AS lang, '' AS source, CAST(sum(tokens) AS BIGINT) AS tokens FROM l3 GROUP BY ALL),
c1 AS (SELECT l1.*, tokens * {epochs} AS capacity, coalesce(t.weight, CAST(floor(sqrt(tokens)) AS BIGINT)) AS weight, (SELECT sum(tokens) FROM l3) AS given, 0 AS root FROM l1 LEFT JOIN t ON t.domain = l1.domain AND t.lang IS NULL),
b1 AS ({_share_sql("c1", "root")}),
c2 AS (SELECT l2.*, l2.tokens * {epochs} AS capacity, coalesce(t.weight, CAST(floor(sqrt(l2.tokens)) AS BIGINT)) AS weight, b1.budget AS given FROM l2 JOIN b1 ON b1.domain = l2.domain LEFT JOIN t ON t.domain = l2.domain AND t.lang = l2.lang),
b2 AS ({_share_sql("c2", "domain")}),
c3 AS (SELECT l3.*, l3.tokens * {epochs} AS capacity, CAST(floor(sqrt(l3.tokens)) AS BIGINT) AS weight, b2.budget AS given FROM l3 JOIN b2 USING (domain, lang)),
b3 AS ({_share_sql("c3", "domain, lang")}),
leaf AS (SELECT domain, lang, source, tokens, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole FROM b3),
placed AS (SELECT d.*, budget, whole, budget - whole * tokens AS rest FROM d JOIN leaf USING (domain, lang, source)),
hashed AS (SELECT *, sha256('{seed}|' || whole || coalesce('|' || doc_id, '') || '|' || sha) AS h FROM placed WHERE rest > 0),
ended AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before FROM hashed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(whole)) AS BIGINT) AS epoch, budget FROM placed
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS BIGINT), budget FROM ended WHERE before < rest"""
