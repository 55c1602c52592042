"""Queries on failing samples and classes: ranks, splits, top lists, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evalframe.functions import exprs as X
from evalframe.functions.vocab import CLASSES, FOCUS_CLASS, SEVERITIES, TAXONOMY, classes, values_sql
from evalframe.operators import confusion as C
from evalframe.operators import failures as E
from evalframe.operators import ranking as R
from evalframe.queries.evaluation import CLASS_TABLE, CONF, COUNTS, conf
from evalframe.queries.fixtures import query

NAMES = dict(CLASSES)


def severity_sql(rate: str) -> str:
    return f"CASE WHEN {rate} IS NULL OR {rate} <= 0 THEN 'NONE' WHEN {rate} >= 0.75 THEN 'CRITICAL' WHEN {rate} >= 0.5 THEN 'HIGH' WHEN {rate} >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END"


RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
ORDER = f"{RANK} DESC, error_rate DESC, error_count DESC, CAST(sample_id AS VARCHAR)"
SF = f"""SELECT *, {severity_sql('error_rate')} AS severity FROM (SELECT model_id, sample_id, group_id, count(*) AS total_pixels, count(CASE WHEN true_class <> pred_class THEN 1 END) AS error_count,
 count(CASE WHEN true_class <> pred_class THEN 1 END) / count(*) AS error_rate, {', '.join(f'count(CASE WHEN true_class = {i} AND pred_class <> {i} THEN 1 END) AS fn{i}' for i, _ in CLASSES)} FROM preds GROUP BY model_id, sample_id, group_id)"""
DOM = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, sample_id ORDER BY n DESC, true_class, pred_class) AS r FROM
 (SELECT model_id, sample_id, true_class, pred_class, count(*) AS n FROM preds WHERE true_class <> pred_class GROUP BY ALL)) WHERE r = 1"""
FAIL = f"SELECT f.*, d.true_class AS dt, d.pred_class AS dp FROM ({SF}) f JOIN ({DOM}) d ON d.model_id = f.model_id AND d.sample_id = f.sample_id"


def samples(t):
    return E.sample_failures(t.preds, ["model_id"], NAMES)


def fails(t, model="baseline"):
    out = E.failing(samples(t))
    return out if model is None else out.where(F.col("model_id") == model)


def records(t):
    """The table of classes squared is stored, since records read it three times, each with conditions that would go down to the join."""
    table, names = t.stored("model confusion", lambda: conf(t)), classes(t.spark)
    return E.error_records(table, C.class_counts(table, ["model_id"], names), ["model_id"], names)


DOM_ROW = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, true_class ORDER BY n DESC, pred_class) AS r FROM ({CONF}) WHERE true_class <> pred_class) WHERE r = 1"
DOM_COL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, pred_class ORDER BY n DESC, true_class) AS r FROM ({CONF}) WHERE true_class <> pred_class) WHERE r = 1"
_REC = f"""SELECT model_id, class_name, 'false_negative' AS error_type, rn AS predicted_class, fn AS error_count, support, CAST(NULL AS VARCHAR) AS dominant_source FROM base
 UNION ALL SELECT model_id, class_name, 'false_positive', class_name, fp, tp + fp, cn FROM base UNION ALL SELECT model_id, class_name, 'class_confusion', rn, row_n, support, NULL FROM base WHERE row_n > 0"""
RECORDS = f"""SELECT *, CAST(row_number() OVER (PARTITION BY model_id ORDER BY {RANK} DESC, coalesce(error_rate, 0) DESC, error_count DESC, class_name, error_type) AS INT) AS rank FROM
 (SELECT *, {severity_sql('error_rate')} AS severity FROM (WITH base AS (SELECT c.*, r.n AS row_n, rk.class_name AS rn, ck.class_name AS cn FROM ({COUNTS}) c LEFT JOIN ({DOM_ROW}) r ON r.model_id = c.model_id AND r.true_class = c.class_index
  LEFT JOIN ({DOM_COL}) k ON k.model_id = c.model_id AND k.pred_class = c.class_index LEFT JOIN {CLASS_TABLE} rk ON rk.class_index = r.pred_class LEFT JOIN {CLASS_TABLE} ck ON ck.class_index = k.true_class)
  SELECT *, error_count / nullif(support, 0) AS error_rate FROM ({_REC})))"""


@query("w01_rank_samples", f"SELECT model_id, sample_id, severity, error_count, row_number() OVER (PARTITION BY model_id ORDER BY {ORDER}) AS rank FROM ({FAIL})")
def _(t):
    ranked = R.rank_samples(t.stored("failures", lambda: fails(t, None)), ["model_id"], written=True)
    return ranked.select("model_id", "sample_id", "severity", "error_count", "rank")


@query("w02_dedup_worst", f"SELECT sample_id, model_id, severity, error_count FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {ORDER}, model_id) AS r FROM ({FAIL})) WHERE r = 1 AND NOT (model_id = 'improved')"
       f" UNION ALL SELECT sample_id, model_id, severity, error_count FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {ORDER}, model_id) AS r FROM ({FAIL})) WHERE r = 1 AND model_id = 'improved'")
def _(t):
    # records that are alike in all that is compared go by model
    both = fails(t, None)
    w = both.groupBy("sample_id").agg(F.min(F.struct((-X.severity_rank(F.col("severity"))).alias("s"), (-F.col("error_rate")).alias("r"), (-F.col("error_count")).alias("c"), "model_id", "severity", "error_count")).alias("w"))
    return w.select("sample_id", "w.model_id", "w.severity", "w.error_count")


@query("w03_dominant_confusion_row", f"SELECT model_id, true_class, pred_class, n FROM ({DOM_ROW})")
def _(t):
    return E.dominant(conf(t), ["model_id"], "true_class", "pred_class")


@query("w04_dominant_confusion_col", f"SELECT model_id, true_class, pred_class, n FROM ({DOM_COL})")
def _(t):
    return E.dominant(conf(t), ["model_id"], "pred_class", "true_class")


@query("w05_dominant_sample_confusion", f"SELECT model_id, sample_id, k.class_name AS dominant_true_class, p.class_name AS dominant_predicted_class FROM ({FAIL}) JOIN {CLASS_TABLE} k ON k.class_index = dt JOIN {CLASS_TABLE} p ON p.class_index = dp")
def _(t):
    return fails(t, None).select("model_id", "sample_id", "dominant_true_class", "dominant_predicted_class")


@query("w06_error_rank", f"SELECT model_id, rank, class_name, error_type FROM ({RECORDS})")
def _(t):
    return records(t).select("model_id", "rank", "class_name", "error_type")


@query("c10_pixel_errors", f"SELECT model_id, class_name, error_type, predicted_class, error_count, support, dominant_source, round(error_rate, 6) AS error_rate, severity, rank FROM ({RECORDS})")
def _(t):
    return records(t).withColumn("error_rate", X.r6(F.col("error_rate")))


CATEGORIES = "'false_positive,false_negative,class_confusion' || CASE WHEN fn0 > 0 THEN ',clear_surface_failure' ELSE '' END || CASE WHEN fn1 > 0 THEN ',thick_cloud_failure' ELSE '' END || CASE WHEN fn2 > 0 THEN ',thin_cloud_failure' ELSE '' END || CASE WHEN fn3 > 0 THEN ',cloud_shadow_failure' ELSE '' END"


@query("c11_sample_failures", f"SELECT model_id, sample_id, group_id, total_pixels, error_count, round(error_rate, 6) AS error_rate, severity, CASE WHEN error_count > 0 THEN {CATEGORIES} ELSE '' END AS categories, fn2 AS focus_errors FROM ({SF})")
def _(t):
    s = samples(t)
    focus = F.coalesce(F.try_element_at("per_class_errors", F.lit(FOCUS_CLASS)), F.lit(0))
    return s.select("model_id", "sample_id", "group_id", "total_pixels", "error_count", X.r6(F.col("error_rate")).alias("error_rate"), "severity", F.array_join("categories", ",").alias("categories"), focus.alias("focus_errors"))


@query("p16_severity", f"SELECT model_id, sample_id, {severity_sql('error_rate')} AS severity FROM ({SF})")
def _(t):
    return samples(t).select("model_id", "sample_id", X.severity(F.col("error_rate")).alias("severity"))


@query("p19_failure_categories", f"SELECT model_id, c AS category, count(*) AS samples FROM (SELECT model_id, unnest(string_split({CATEGORIES}, ',')) AS c FROM ({FAIL})) GROUP BY ALL")
def _(t):
    return fails(t, None).select("model_id", F.explode("categories").alias("category")).groupBy("model_id", "category").agg(F.count("*").alias("samples"))


@query("p20_measurability", f"""SELECT m.model_id, v.category, v.measurability, count(f.c) AS samples FROM {values_sql(TAXONOMY, 'category, measurability')} CROSS JOIN (SELECT DISTINCT model_id FROM preds) m
 LEFT JOIN (SELECT model_id, unnest(string_split({CATEGORIES}, ',')) AS c FROM ({FAIL})) f ON f.c = v.category AND f.model_id = m.model_id WHERE v.measurability = 'measurable' GROUP BY ALL""")
def _(t):
    seen = fails(t, None).select("model_id", F.explode("categories").alias("category")).groupBy("model_id", "category").agg(F.count("*").alias("samples"))
    every = t.preds.select("model_id").distinct().crossJoin(F.broadcast(E.measurability(t.spark, "measurable")))  # models and categories are few
    return every.join(seen, ["model_id", "category"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


def top_sql(order: str, label: str, value: str, where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT model_id, sample_id, '{label}' AS criterion, CAST({value} AS DOUBLE) AS value, CAST(row_number() OVER (PARTITION BY model_id ORDER BY {order} DESC, {ORDER}) AS INT) AS rank, severity FROM ({FAIL}) WHERE {where}) WHERE rank <= 20"""


TOPS = {
    "t01_topk_rate": top_sql("error_rate", "error_rate", "error_rate"),
    "t02_topk_count": top_sql("error_count", "error_count", "error_count"),
    "t03_topk_class": top_sql("error_rate", FOCUS_CLASS, "error_rate", "fn2 > 0 OR dt = 2"),
    "t04_topk_error_type": top_sql("error_rate", "class_confusion", "error_rate"),
}
OPTIONS = {"t01_topk_rate": {}, "t02_topk_count": {"criterion": "error_count"}, "t03_topk_class": {"class_name": FOCUS_CLASS}, "t04_topk_error_type": {"error_type": "class_confusion"}}
for _name, _sql in TOPS.items():
    query(_name, _sql)(lambda t, o=OPTIONS[_name]: R.top_k(fails(t, None), 20, by=["model_id"], **o))


@query("t05_hard_examples", " UNION ALL ".join(f"(SELECT * FROM ({s}))" for s in TOPS.values()))
def _(t):
    return E.hard_examples(t.stored("failures", lambda: fails(t, None)), 20, FOCUS_CLASS, by=["model_id"])  # four lists read them


CLASS_SUM = f"""SELECT r.model_id, r.class_name, r.error_count AS total_errors, r.error_rate, (SELECT count(*) FROM ({FAIL}) f WHERE f.model_id = r.model_id AND CASE r.class_name WHEN 'clear' THEN fn0 WHEN 'thick_cloud' THEN fn1 WHEN 'thin_cloud' THEN fn2 ELSE fn3 END > 0) AS sample_count
 FROM ({RECORDS}) r WHERE error_type = 'false_negative'"""
TYPE_SUM = f"SELECT r.model_id, error_type, CAST(sum(error_count) AS BIGINT) AS total_errors, (SELECT count(*) FROM ({FAIL}) f WHERE f.model_id = r.model_id) AS sample_count FROM ({RECORDS}) r GROUP BY ALL"
GROUP_SUM = f"SELECT model_id, group_id AS stratum, CAST(sum(error_count) AS BIGINT) AS total_errors, count(*) AS sample_count, round(sum(error_count) / sum(total_pixels), 6) AS error_rate FROM ({FAIL}) GROUP BY ALL"


def class_sums(t):
    return E.class_summary(records(t), fails(t, None), ["model_id"], classes(t.spark))


def type_sums(t):
    return E.error_type_summary(records(t), fails(t, None), ["model_id"])


@query("g26_class_failure_summary", f"SELECT model_id, class_name, total_errors, round(error_rate, 6) AS error_rate, sample_count FROM ({CLASS_SUM})")
def _(t):
    return class_sums(t).withColumn("error_rate", X.r6(F.col("error_rate"))).drop("severity_distribution")


@query("g27_error_type_summary", TYPE_SUM)
def _(t):
    return type_sums(t)


@query("g28_group_failure_summary", f"{GROUP_SUM}")
def _(t):
    return E.group_summary(fails(t, None), ["model_id"]).withColumn("error_rate", X.r6(F.col("error_rate"))).drop("severity_distribution")


ARM = f"""SELECT f.model_id, total_failures, critical, false_positives, false_negatives, class_confusion, focus_failures FROM (SELECT model_id, count(*) AS total_failures, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical FROM ({FAIL}) GROUP BY ALL) f
 JOIN (SELECT model_id, {', '.join(f"CAST(sum(CASE WHEN error_type = '{k}' THEN error_count ELSE 0 END) AS BIGINT) AS {n}" for k, n in (('false_positive', 'false_positives'), ('false_negative', 'false_negatives'), ('class_confusion', 'class_confusion')))},
 CAST(sum(CASE WHEN error_type = 'false_negative' AND class_name = '{FOCUS_CLASS}' THEN error_count ELSE 0 END) AS BIGINT) AS focus_failures FROM ({RECORDS}) GROUP BY ALL) r ON r.model_id = f.model_id"""


def arms(t):
    return E.arm_summary(records(t), fails(t, None), ["model_id"], FOCUS_CLASS)


@query("g29_arm_failure_summary", ARM)
def _(t):
    return arms(t).withColumn("critical", F.coalesce(F.try_element_at("severity_distribution", F.lit("CRITICAL")), F.lit(0))).drop("severity_distribution")


TOP_CATEGORIES = f"""SELECT model_id, category, type, total_errors, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY total_errors DESC, category) AS rank FROM
 (SELECT model_id, error_type AS category, 'error_type' AS type, total_errors FROM ({TYPE_SUM}) UNION ALL SELECT model_id, class_name, 'class', total_errors FROM ({CLASS_SUM})) WHERE total_errors > 0) WHERE rank <= 5"""


@query("t06_top_categories", TOP_CATEGORIES)
def _(t):
    return E.top_categories(type_sums(t), class_sums(t), ["model_id"])


@query("t07_topk_per_group", f"SELECT model_id, group_id, sample_id, severity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model_id, group_id ORDER BY error_rate DESC, {ORDER}) AS rank FROM ({FAIL})) WHERE rank <= 5")
def _(t):
    return R.top_k_per_group(fails(t, None), ["model_id", "group_id"], 5).select("model_id", "group_id", "sample_id", "severity", "rank")


ANALYSIS = f"""SELECT model_id, 'sample' AS section, CAST(sample_id AS VARCHAR) AS item, severity, error_count AS errors FROM ({FAIL}) UNION ALL
 SELECT model_id, 'class', class_name || '/' || error_type, severity, error_count FROM ({RECORDS}) UNION ALL
 SELECT model_id, 'hard', criterion || '/' || sample_id, severity, rank FROM ({" UNION ALL ".join(f"(SELECT * FROM ({s}))" for s in TOPS.values())})"""


def listed(t):
    """Failing samples of all models are stored once, since five parts of the list read them."""
    own = t.stored("failures", lambda: fails(t, None))
    hard = E.hard_examples(own, 20, FOCUS_CLASS, by=["model_id"])
    parts = [
        own.select("model_id", F.lit("sample").alias("section"), F.col("sample_id").cast("string").alias("item"), "severity", F.col("error_count").alias("errors")),
        records(t).select("model_id", F.lit("class").alias("section"), F.concat_ws("/", "class_name", "error_type").alias("item"), "severity", F.col("error_count").alias("errors")),
        hard.select("model_id", F.lit("hard").alias("section"), F.concat_ws("/", "criterion", "sample_id").alias("item"), "severity", F.col("rank").cast("long").alias("errors")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Columns of an analysis besides model and section; a section leaves those null that it does not have.
PARTS = {"item": "string", "severity": "string", "errors": "bigint", "rank": "bigint", "total": "bigint", "value": "double", "sample_count": "bigint", "severities": "string", "detail": "string"}
_LIMITS = [("real_data", "Real-data failure statistics: NOT YET MEASURED (synthetic inputs only).")]
_LIMITS += [(c, f"{c}: DEFERRED (needs spatial mask analysis)." if m == "deferred" else f"{c}: NOT MEASURABLE (needs predicted probabilities/confidence).") for c, m in TAXONOMY if m != "measurable"]


def part_sql(section: str, rows: str, **columns: str) -> str:
    return f"SELECT model_id, '{section}' AS section, {', '.join(f'CAST({columns.get(c, 'NULL')} AS {kind.replace('string', 'VARCHAR')}) AS {c}' for c, kind in PARTS.items())} FROM {rows}"


_SEVERITIES = "concat_ws(',', " + ", ".join(f"CASE WHEN count(CASE WHEN severity = '{s}' THEN 1 END) > 0 THEN '{s}:' || count(CASE WHEN severity = '{s}' THEN 1 END) END" for s in SEVERITIES) + ")"
_FN = "CASE k.class_index " + " ".join(f"WHEN {i} THEN fn{i}" for i, _ in CLASSES) + " END"
_DETAIL = f"""concat_ws('|', coalesce(group_id, ''), (SELECT class_name FROM {CLASS_TABLE} WHERE class_index = dt) || '>' || (SELECT class_name FROM {CLASS_TABLE} WHERE class_index = dp), {CATEGORIES},
 concat_ws(',', {', '.join(f"CASE WHEN fn{i} > 0 THEN '{n}:' || fn{i} END" for i, n in CLASSES)}))"""
WHOLE_ANALYSIS = f"WITH failed AS ({FAIL}), recorded AS ({RECORDS}), models AS (SELECT DISTINCT model_id FROM preds) " + " UNION ALL ".join([
    part_sql("sample", "failed", item="sample_id", severity="severity", errors="error_count", rank=f"row_number() OVER (PARTITION BY model_id ORDER BY {ORDER})", total="total_pixels", value="round(error_rate, 6)", detail=_DETAIL),
    part_sql("class", "recorded", item="class_name || '/' || error_type", severity="severity", errors="error_count", rank="rank", total="support", value="round(error_rate, 6)", detail="concat_ws('|', predicted_class, dominant_source)"),
    part_sql("hard", f"({' UNION ALL '.join(f'(SELECT * FROM ({s}))' for s in TOPS.values())})", item="criterion || '/' || sample_id", severity="severity", errors="rank", rank="rank", value="round(value, 6)"),
    part_sql("class_summary", f"""(SELECT r.model_id, r.class_name, r.error_count, r.error_rate, n, by_severity FROM recorded r LEFT JOIN (SELECT model_id, class_name AS c, count(*) AS n, {_SEVERITIES} AS by_severity FROM failed JOIN {CLASS_TABLE} k ON {_FN} > 0 GROUP BY ALL) s
 ON s.model_id = r.model_id AND s.c = r.class_name WHERE error_type = 'false_negative')""", item="class_name", errors="error_count", value="round(error_rate, 6)", sample_count="coalesce(n, 0)", severities="coalesce(by_severity, '')"),
    part_sql("error_type_summary", f"""(SELECT m.model_id, v.error_type, coalesce((SELECT sum(error_count) FROM recorded r WHERE r.model_id = m.model_id AND r.error_type = v.error_type), 0) AS e, (SELECT count(*) FROM failed f WHERE f.model_id = m.model_id) AS n
 FROM models m CROSS JOIN {values_sql(tuple((k,) for k in E.TYPES), 'error_type')})""", item="error_type", errors="e", sample_count="n"),
    part_sql("group_summary", f"(SELECT model_id, coalesce(nullif(group_id, ''), '_ungrouped') AS g, sum(error_count) AS e, sum(error_count) / sum(total_pixels) AS rate, count(*) AS n, {_SEVERITIES} AS by_severity FROM failed GROUP BY ALL)", item="g", errors="e", value="round(rate, 6)", sample_count="n", severities="by_severity"),
    part_sql("taxonomy", f"models CROSS JOIN {values_sql(TAXONOMY, 'category, measurability')}", item="category", detail="measurability"),
    part_sql("limitation", f"models CROSS JOIN {values_sql(tuple(_LIMITS), 'topic, line')}", item="topic", detail="line"),
    part_sql("limitation", "models WHERE model_id NOT IN (SELECT model_id FROM failed)", item="'samples'", detail="'Sample-level analysis: not available (no per-sample predictions provided).'"),
])


def analysis(t):
    """All that an analysis of failures holds, for each model: ranked samples and classes, hard examples, summaries by class, error type and
    group, taxonomy and limitations. Failing samples are stored once, since nine parts read them."""
    own, by, c = t.stored("failures", lambda: fails(t, None)), ["model_id"], F.col
    models = t.stored("model confusion", lambda: conf(t)).select("model_id").distinct()
    types = models.crossJoin(F.broadcast(t.spark.createDataFrame([(k,) for k in E.TYPES], "error_type string")))
    joined = lambda m: F.coalesce(F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"])), ","), F.lit(""))
    detail = F.concat_ws("|", F.coalesce("group_id", F.lit("")), F.concat_ws(">", "dominant_true_class", "dominant_predicted_class"), F.array_join("categories", ","), joined("per_class_errors"))

    ranked = R.rank_samples(own.select("model_id", "sample_id", "severity", "error_count", "total_pixels", "error_rate", detail.alias("detail")), by, written=True)

    def part(section: str, rows, **columns):
        return rows.select("model_id", F.lit(section).alias("section"), *[columns.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in PARTS.items()])

    parts = [
        part("sample", ranked, item=c("sample_id"), severity=c("severity"), errors=c("error_count"), rank=c("rank"), total=c("total_pixels"), value=X.r6(c("error_rate")), detail=c("detail")),
        part("class", records(t), item=F.concat_ws("/", "class_name", "error_type"), severity=c("severity"), errors=c("error_count"), rank=c("rank"), total=c("support"), value=X.r6(c("error_rate")), detail=F.concat_ws("|", "predicted_class", "dominant_source")),
        part("hard", E.hard_examples(own, 20, FOCUS_CLASS, by=by), item=F.concat_ws("/", "criterion", "sample_id"), severity=c("severity"), errors=c("rank"), rank=c("rank"), value=X.r6(c("value"))),
        part("class_summary", E.class_summary(records(t), own, by, classes(t.spark)), item=c("class_name"), errors=c("total_errors"), value=X.r6(c("error_rate")), sample_count=c("sample_count"), severities=joined("severity_distribution")),
        part("error_type_summary", types.join(E.error_type_summary(records(t), own, by), [*by, "error_type"], "left"), item=c("error_type"), errors=F.coalesce("total_errors", F.lit(0)), sample_count=F.coalesce("sample_count", F.lit(0))),
        part("group_summary", E.group_summary(own, by), item=c("stratum"), errors=c("total_errors"), value=X.r6(c("error_rate")), sample_count=c("sample_count"), severities=joined("severity_distribution")),
        part("taxonomy", models.crossJoin(F.broadcast(E.measurability(t.spark))), item=c("category"), detail=c("measurability")),
        part("limitation", E.limitations(models, own, by), item=c("topic"), detail=c("text")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("c12_analyze_failures", WHOLE_ANALYSIS)
def _(t):
    return analysis(t)


@query("c17_failure_report", f"SELECT model_id, section, severity, count(*) AS rows, CAST(sum(errors) AS BIGINT) AS errors FROM ({ANALYSIS}) GROUP BY ALL UNION ALL SELECT 'all', 'taxonomy', measurability, count(*), 0 FROM {values_sql(TAXONOMY, 'category, measurability')} GROUP BY ALL")
def _(t):
    tax = E.measurability(t.spark).groupBy("measurability").agg(F.count("*").alias("rows"))
    own = listed(t).groupBy("model_id", "section", "severity").agg(F.count("*").alias("rows"), F.sum("errors").alias("errors"))
    return own.unionByName(tax.select(F.lit("all").alias("model_id"), F.lit("taxonomy").alias("section"), F.col("measurability").alias("severity"), "rows", F.lit(0).cast("long").alias("errors")))


def flat_sql(ids: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN rank <= floor(total * 0.15) THEN 'val' WHEN rank <= floor(total * 0.15) * 2 THEN 'test' ELSE 'train' END AS split
 FROM (SELECT {key}, row_number() OVER (ORDER BY sha256('42|' || {key}), {key}) AS rank, count(*) OVER () AS total FROM ({ids}))"""


FLAT = flat_sql("SELECT o_orderkey AS sample_id FROM orders", "sample_id")


def flat(t):
    return R.split_flat(t.orders.select(F.col("o_orderkey").alias("sample_id")))


@query("w11_exact_split_flat", FLAT)
def _(t):
    return flat(t)


def group_ids(t):
    return t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").cast("string").alias("group_id"))


GROUPS = f"SELECT o_orderkey AS sample_id, CAST(o_custkey AS VARCHAR) AS group_id, split FROM orders JOIN ({flat_sql('SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS g FROM orders', 'g')}) s ON s.g = CAST(o_custkey AS VARCHAR)"


@query("w12_exact_split_group", GROUPS)
def _(t):
    return R.split_groups(group_ids(t), "group_id")


LABEL_PAIRS = "SELECT DISTINCT l_orderkey AS sample_id, l_returnflag AS label FROM lineitem"
REQUIRED = ["A", "R", "N"]


@query("w13_curated_subset", f"""WITH has AS ({LABEL_PAIRS}), air AS (SELECT min(sample_id) AS s FROM has WHERE label = 'A'),
 rail AS (SELECT min(sample_id) AS s FROM has WHERE label = 'R' AND NOT EXISTS (SELECT 1 FROM has h JOIN air ON h.sample_id = air.s WHERE h.label = 'R')),
 first AS (SELECT s FROM air UNION SELECT s FROM rail WHERE s IS NOT NULL),
 ship AS (SELECT min(sample_id) AS s FROM has WHERE label = 'N' AND NOT EXISTS (SELECT 1 FROM has h JOIN first ON h.sample_id = first.s WHERE h.label = 'N')),
 forced AS (SELECT s FROM first UNION SELECT s FROM ship WHERE s IS NOT NULL)
 SELECT s AS sample_id, true AS forced FROM forced UNION ALL SELECT sample_id, false FROM (SELECT o_orderkey AS sample_id, row_number() OVER (ORDER BY sha256('42|' || o_orderkey), o_orderkey) AS rank FROM orders WHERE o_orderkey NOT IN (SELECT s FROM forced)) WHERE rank <= 500 - (SELECT count(*) FROM forced)""")
def _(t):
    pairs = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("label")).distinct()
    return R.curated_subset(t.orders.select(F.col("o_orderkey").alias("sample_id")), pairs, REQUIRED, 500)


@query("j11_leakage_check", "SELECT o_custkey AS group_id, count(DISTINCT split) AS splits FROM orders JOIN (" + FLAT + ") s ON s.sample_id = o_orderkey GROUP BY ALL HAVING count(DISTINCT split) > 1")
def _(t):
    owners = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_id"))
    return R.leakage(flat(t).join(owners, "sample_id"), "group_id")


@query("u02_split_intersection", f"SELECT g AS group_id, a.split AS first, b.split AS second FROM (SELECT DISTINCT o_custkey AS g, split FROM orders JOIN ({FLAT}) s ON s.sample_id = o_orderkey) a JOIN (SELECT DISTINCT o_custkey AS g2, split FROM orders JOIN ({FLAT}) s ON s.sample_id = o_orderkey) b ON g = g2 AND (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test'))")
def _(t):
    owners = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_id"))
    return R.split_overlaps(flat(t).join(owners, "sample_id"), "group_id")


@query("j04_samples_by_split", f"SELECT o.o_orderkey AS sample_id, o_orderstatus, split FROM orders o JOIN ({FLAT}) s ON s.sample_id = o.o_orderkey WHERE split = 'val'")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("sample_id"), "o_orderstatus").join(flat(t).where("split = 'val'"), "sample_id")


@query("p24_split_isolation", f"SELECT l_orderkey AS sample_id, split, count(*) AS rows FROM lineitem JOIN ({FLAT}) s ON s.sample_id = l_orderkey WHERE split <> 'train' GROUP BY ALL")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("sample_id")).join(flat(t), "sample_id")
    return rows.where("split <> 'train'").groupBy("sample_id", "split").agg(F.count("*").alias("rows"))


@query("u04_missing_classes", f"SELECT s.sample_id, string_agg(r.label, ',' ORDER BY r.label) AS missing FROM (SELECT DISTINCT sample_id FROM ({LABEL_PAIRS})) s CROSS JOIN (VALUES ('A'), ('R'), ('N')) AS r(label) WHERE NOT EXISTS (SELECT 1 FROM ({LABEL_PAIRS}) h WHERE h.sample_id = s.sample_id AND h.label = r.label) GROUP BY ALL")
def _(t):
    present = t.lineitem.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.collect_set("l_returnflag").alias("has"))
    gone = F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("has"))
    return present.select("sample_id", F.array_join(F.array_sort(gone), ",").alias("missing")).where("missing <> ''")


@query("u05_covered_classes", f"""SELECT o.o_orderpriority AS subset, r.label, EXISTS (SELECT 1 FROM ({LABEL_PAIRS}) h JOIN orders i ON i.o_orderkey = h.sample_id WHERE h.label = r.label AND i.o_orderpriority = o.o_orderpriority) AS covered
 FROM (SELECT DISTINCT o_orderpriority FROM orders) o CROSS JOIN (VALUES ('A'), ('R'), ('X')) AS r(label)""")
def _(t):
    """The orders of each priority as a subset."""
    chosen = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("subset"))
    seen = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("label")).join(chosen, "l_orderkey").select("subset", "label").distinct().withColumn("covered", F.lit(True))
    need = chosen.select("subset").distinct().crossJoin(F.broadcast(t.spark.createDataFrame([("A",), ("R",), ("X",)], "label string")))
    return need.join(seen, ["subset", "label"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
