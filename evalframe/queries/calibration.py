"""Queries on confidence: reliability bins, calibration errors, AUC, errors by confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.exprs import r6
from evalframe.operators import calibration as K
from evalframe.functions.vocab import TAXONOMY, values_sql
from evalframe.operators import failures as E
from evalframe.operators import objects as O
from evalframe.queries.failures import CATEGORIES, FAIL, fails
from evalframe.queries.fixtures import query
from evalframe.queries.objects import OBJECTS, SPATIAL, objects

#: The temperature at which the given vectors, taken as logits, give confidences over all bins.
T, HIGH, LOW = 0.1, 0.7, 0.3
_P = "list_transform(l, lambda x: round(exp(x - (list_max(l) + ln(list_sum(list_transform(l, lambda y: exp(y - list_max(l))))))), 9))"
SCORES = f"SELECT vec_id % 4 AS fold, label, list_position(l, list_max(l)) - 1 AS predicted, {_P} AS p FROM (SELECT vec_id, label, list_transform(logits, lambda x: CAST(x AS DOUBLE) / {T}) AS l FROM logits)"
CONFIDENT = f"SELECT fold, label, predicted = label AS correct, list_max(p) AS confidence FROM ({SCORES})"
BINS = f"SELECT fold, CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n, sum(confidence) AS cs, count(CASE WHEN correct THEN 1 END) AS correct FROM ({CONFIDENT}) GROUP BY ALL"


def errors_sql(keys: str, hist: str) -> str:
    return f"SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, round(sum(correct) / sum(n), 6) AS accuracy, round(sum(cs) / sum(n), 6) AS confidence, round(sum(abs(correct - cs)) / sum(n), 6) AS ece, round(max(abs(correct - cs) / n), 6) AS mce FROM ({hist}) GROUP BY ALL"


def auc_sql(key: str, score: str, positive: str, rows: str) -> str:
    """By the mean rank of the positives."""
    return f"""SELECT {key}, CAST(sum(CASE WHEN {positive} THEN 1 ELSE 0 END) AS BIGINT) AS positives, CAST(sum(CASE WHEN {positive} THEN 0 ELSE 1 END) AS BIGINT) AS negatives,
 round((sum(CASE WHEN {positive} THEN r END) - positives * (positives + 1) / 2) / nullif(positives * negatives, 0), 6) AS auc
 FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY {score}) + (count(*) OVER (PARTITION BY {key}, {score}) - 1) / 2 AS r FROM ({rows})) GROUP BY {key}"""


def confident(t):
    return K.confident(t.logits.withColumn("fold", F.col("vec_id") % 4), temperature=T)


@query("g42_reliability", f"SELECT fold, bin, n, round(cs / n, 6) AS confidence, round(correct / n, 6) AS accuracy FROM ({BINS})")
def _(t):
    h = K.reliability(confident(t), ["fold"])
    return h.select("fold", "bin", "n", r6(F.col("confidence_sum") / F.col("n")).alias("confidence"), r6(F.col("correct") / F.col("n")).alias("accuracy"))


@query("g43_calibration_error", errors_sql("CAST(fold AS VARCHAR) AS fold", BINS) + " UNION ALL " + errors_sql("'all' AS fold", f"SELECT bin, sum(n) AS n, sum(cs) AS cs, sum(correct) AS correct FROM ({BINS}) GROUP BY ALL"))
def _(t):
    h = K.reliability(confident(t), ["fold"])
    both = K.calibration_error(h.withColumn("fold", F.col("fold").cast("string")), ["fold"]).unionByName(K.calibration_error(K.merge_reliability([h], []), []).withColumn("fold", F.lit("all")))
    return both.select("fold", "n", *[r6(F.col(c)).alias(c) for c in ("accuracy", "confidence", "ece", "mce")])


@query("g44_confidence_auc", auc_sql("fold", "confidence", "correct", CONFIDENT))
def _(t):
    return K.auc(confident(t), ["fold"], "confidence", "correct").withColumn("auc", r6(F.col("auc")))


@query("g45_class_auc", auc_sql("class_index", "score", "positive", f"SELECT class_index, score, class_index = label AS positive FROM (SELECT label, CAST(unnest(range(10)) AS INT) AS class_index, unnest(p) AS score FROM ({SCORES}))"))
def _(t):
    return K.auc(K.class_scores(t.logits, temperature=T), ["class_index"], "score", "positive").withColumn("auc", r6(F.col("auc")))


@query("p33_confidence_errors", f"SELECT label, count(*) AS n, count(CASE WHEN NOT correct THEN 1 END) AS errors, count(CASE WHEN NOT correct AND confidence >= {HIGH} THEN 1 END) AS high_confidence_error, count(CASE WHEN NOT correct AND confidence < {LOW} THEN 1 END) AS low_confidence_error FROM ({CONFIDENT}) GROUP BY ALL")
def _(t):
    return K.confidence_errors(confident(t), ["label"], HIGH, LOW)


@query("p35_measured_taxonomy", f"""WITH RECURSIVE {OBJECTS}, {SPATIAL}, found AS (SELECT unnest(string_split({CATEGORIES}, ',')) AS category, 1 AS n FROM ({FAIL})
 UNION ALL SELECT 'edge_error', 1 FROM sums WHERE edge_errors > 0 UNION ALL SELECT 'small_object_failure', 1 FROM sums WHERE small_failures > 0
 UNION ALL SELECT 'high_confidence_error', 1 FROM ({CONFIDENT}) WHERE NOT correct AND confidence >= {HIGH} UNION ALL SELECT 'low_confidence_error', 1 FROM ({CONFIDENT}) WHERE NOT correct AND confidence < {LOW})
 SELECT v.category, count(f.n) AS cases FROM {values_sql(TAXONOMY, 'category, measurability')} LEFT JOIN found f ON f.category = v.category GROUP BY ALL""")
def _(t):
    return E.measured_counts(fails(t, None), O.spatial_failures(objects(t)), K.confidence_errors(confident(t), [], HIGH, LOW))
