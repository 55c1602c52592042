"""Queries that compare two models: deltas, fairness, compute, verdicts, artifacts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import exprs as X
from evalframe.functions.vocab import COLORS, FOCUS_CLASS, IDENTITY_PATHS, classes, values_sql
from evalframe.operators import compare as M
from evalframe.operators import confusion as C
from evalframe.operators import failures as E
from evalframe.queries.evaluation import FORMULA, METRICS_SQL, STRATA, conf, counts_sql
from evalframe.queries.failures import ARM, TOP_CATEGORIES, arms, class_sums, type_sums
from evalframe.queries.fixtures import query

KEYS = ["stratum", "class_name"]
METRIC_STRATA = f"SELECT *, {METRICS_SQL} FROM ({counts_sql(STRATA, 'model_id, stratum')})"
DELTAS_SQL = f"""SELECT b.stratum, b.class_name, b.class_index, {', '.join(f'b.{m} AS b_{m}, i.{m} AS i_{m}, round(i.{m} - b.{m}, 6) AS d_{m}' for m in FORMULA)}, b.fn AS b_fn, i.fn AS i_fn, b.support AS b_support, i.support AS i_support
 FROM ({METRIC_STRATA}) b LEFT JOIN ({METRIC_STRATA}) i ON i.stratum = b.stratum AND i.class_name = b.class_name AND i.model_id = 'improved' WHERE b.model_id = 'baseline'"""


def metrics(t):
    """Class metrics of both arms, which an evaluation stores and comparisons read."""
    keys = ["model_id", "stratum"]
    table = t.stored("confusion", lambda: C.strata(conf(t, ("model_id", "group_id")), "group_id", ["model_id"]))
    return C.class_metrics(C.class_counts(table, keys, classes(t.spark)))


def two(df):
    return [df.where(F.col("model_id") == m).drop("model_id") for m in ("baseline", "improved")]


def deltas(t):
    return M.metric_deltas(*two(metrics(t)), KEYS)


@query("j07_arm_class_join", f"SELECT stratum, class_name, round(b_iou, 6) AS baseline_iou, CASE WHEN class_name <> 'clear' THEN round(i_iou, 6) END AS improved_iou FROM ({DELTAS_SQL})")
def _(t):
    base, new = two(metrics(t))
    out = M.arm_join(base, new.where("class_name <> 'clear'"), KEYS, ("iou",))
    return out.withColumns({c: X.r6(F.col(c)) for c in ("baseline_iou", "improved_iou")})


@query("g31_metric_deltas", f"SELECT stratum, class_name, {', '.join(f'd_{m} AS {m}_delta' for m in FORMULA)} FROM ({DELTAS_SQL})")
def _(t):
    return deltas(t).select(*KEYS, *[f"{m}_delta" for m in FORMULA])


FOCUS_SQL = f"""SELECT stratum, d_iou AS iou_delta, d_dice AS dice_delta, d_recall AS recall_delta, CAST(i_fn - b_fn AS BIGINT) AS fn_delta,
 CASE WHEN d_iou IS NULL AND d_dice IS NULL THEN NULL ELSE coalesce(d_iou < 0, false) OR coalesce(d_dice < 0, false) END AS regressed FROM ({DELTAS_SQL}) WHERE class_name = '{FOCUS_CLASS}'"""


def focus(t):
    return M.focus_delta(*two(metrics(t)), KEYS, FOCUS_CLASS)


@query("g32_focus_class_delta", FOCUS_SQL)
def _(t):
    return focus(t).select("stratum", "iou_delta", "dice_delta", "recall_delta", F.col("fn_delta").cast("long").alias("fn_delta"), "regressed")


@query("g33_failure_deltas", f"SELECT CAST(i.focus_failures - b.focus_failures AS BIGINT) AS focus_failures_delta, i.total_failures - b.total_failures AS total_failures_delta, i.focus_failures < b.focus_failures AND i.false_negatives <= b.false_negatives AS hypothesis_supported FROM ({ARM}) b, ({ARM}) i WHERE b.model_id = 'baseline' AND i.model_id = 'improved'")
def _(t):
    base, new = two(arms(t).withColumn("k", F.lit(0)))
    out = M.failure_deltas(base, new, ["k"], "MEASURED")
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("focus_failures_delta", "total_failures_delta")], "hypothesis_supported")


COMPUTE = """SELECT model_id, group_id AS stratum, count(*) + sum(pred_class) AS parameters, CAST(sum(CASE WHEN true_class <> pred_class THEN 1 ELSE 0 END) AS DOUBLE) AS train_seconds,
 CAST(sum(CASE WHEN group_id = '1-URGENT' THEN 0 ELSE pred_class END) AS DOUBLE) AS infer_seconds, CASE WHEN model_id = 'improved' THEN 'MEASURED' ELSE 'SYNTHETIC' END AS status FROM preds GROUP BY ALL"""


def compute(t):
    wrong = F.when(F.col("true_class") != F.col("pred_class"), 1).otherwise(0)
    rows = t.stored("compute", lambda: t.preds.groupBy("model_id", F.col("group_id").alias("stratum")).agg((F.count("*") + F.sum("pred_class")).alias("parameters"), F.sum(wrong).cast("double").alias("train_seconds"), F.sum(F.when(F.col("group_id") == "1-URGENT", 0).otherwise(F.col("pred_class"))).cast("double").alias("infer_seconds")))
    return rows.withColumn("status", F.when(F.col("model_id") == "improved", "MEASURED").otherwise("SYNTHETIC"))


RATIOS_SQL = f"""SELECT b.stratum, round(CAST(i.parameters AS DOUBLE) / b.parameters, 6) AS parameter_ratio, CAST(i.parameters - b.parameters AS BIGINT) AS parameter_delta, round(i.train_seconds / nullif(b.train_seconds, 0), 6) AS train_ratio,
 round(i.infer_seconds / nullif(b.infer_seconds, 0), 6) AS infer_ratio, 'MEASURED' AS status FROM ({COMPUTE}) b JOIN ({COMPUTE}) i ON i.stratum = b.stratum AND i.model_id = 'improved' WHERE b.model_id = 'baseline'"""


def ratios(t):
    return M.compute_ratios(*two(compute(t)), ["stratum"])


@query("g30_compute_ratios", RATIOS_SQL)
def _(t):
    return ratios(t)


@query("j13_delta_vs_baseline", f"SELECT c.stratum, c.model_id, CAST(c.parameters - b.parameters AS BIGINT) AS parameters_delta FROM ({COMPUTE}) c LEFT JOIN ({COMPUTE}) b ON b.stratum = c.stratum AND b.model_id = 'baseline'")
def _(t):
    return M.delta_vs_baseline(compute(t), ["stratum"], "baseline", "parameters").select("stratum", "model_id", "parameters_delta")


def controls_sql(status: str) -> str:
    return f"SELECT 'training.' || o_orderpriority || '.' || (o_custkey % 50) AS path, CAST(count(*) AS VARCHAR) AS value FROM orders WHERE o_orderstatus = '{status}' GROUP BY ALL"


def controls(t, status: str):
    path = F.concat(F.lit("training."), "o_orderpriority", F.lit("."), (F.col("o_custkey") % 50).cast("string"))
    return t.orders.where(F.col("o_orderstatus") == status).groupBy(path.alias("path")).agg(F.count("*").cast("string").alias("value"))


FAIR = f"SELECT coalesce(b.path, i.path) AS path, b.value AS baseline, i.value AS improved, b.value IS NOT DISTINCT FROM i.value AS matches FROM ({controls_sql('O')}) b FULL JOIN ({controls_sql('F')}) i ON b.path = i.path"


@query("j08_fairness_diff", FAIR)
def _(t):
    return M.fairness(controls(t, "O"), controls(t, "F"))


@query("p25_control_lookup", "SELECT c_custkey, json_extract_string(json_object('training', json_object('segment', c_mktsegment, 'nation', c_nationkey)), '$.training.segment') AS segment, json_extract_string(json_object('training', json_object('segment', c_mktsegment, 'nation', c_nationkey)), '$.training.seed') AS seed FROM customer")
def _(t):
    json = F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("training")))
    return t.customer.select("c_custkey", X.control(json, "training.segment").alias("segment"), X.control(json, "training.seed").alias("seed"))


_ID_SQL = ", ".join(f"'{p}'" for p in IDENTITY_PATHS)
_PATH = "CASE o_custkey % 4 WHEN 0 THEN 'training.experiment_name' WHEN 1 THEN 'training.epochs' WHEN 2 THEN 'failure.model_id' ELSE 'seed' END"


@query("p26_drop_identity_controls", f"SELECT path, count(*) AS n FROM (SELECT {_PATH} AS path FROM orders) WHERE path NOT IN ({_ID_SQL}) GROUP BY ALL")
def _(t):
    k = F.col("o_custkey") % 4
    path = F.when(k == 0, "training.experiment_name").when(k == 1, "training.epochs").when(k == 2, "failure.model_id").otherwise("seed")
    return M.shared_controls(t.orders.select(path.alias("path"))).groupBy("path").agg(F.count("*").alias("n"))


MACRO_SQL = f"SELECT stratum, round(avg(i_iou) - avg(b_iou), 6) AS macro_delta, round(arg_min(d_iou, struct_pack(a := b_iou, b := class_index)), 6) AS worst_delta FROM ({DELTAS_SQL}) GROUP BY ALL"
JUDGED_SQL = f"""SELECT f.stratum, f.iou_delta AS focus_delta, m.macro_delta, m.worst_delta, f.regressed, r.parameter_ratio, r.train_ratio, CAST(length(f.stratum) % 4 AS INT) AS seeds
 FROM ({FOCUS_SQL}) f JOIN ({MACRO_SQL}) m ON m.stratum = f.stratum LEFT JOIN ({RATIOS_SQL}) r ON r.stratum = f.stratum"""
DECIDED_SQL = f"""SELECT *, CASE WHEN focus_delta IS NULL OR macro_delta IS NULL OR seeds < 1 THEN 'INCONCLUSIVE' WHEN focus_delta <= -0.01 OR coalesce(regressed, false) OR coalesce(worst_delta <= -0.01, false) THEN 'REGRESSION'
 WHEN focus_delta >= 0.01 AND macro_delta >= -0.01 THEN CASE WHEN (coalesce(parameter_ratio > 1.5, false) OR coalesce(train_ratio > 1.5, false)) AND focus_delta < 0.03 THEN 'COMPUTE_UNJUSTIFIED' ELSE 'IMPROVED' END ELSE 'NO_SIGNIFICANT_IMPROVEMENT' END AS outcome FROM ({JUDGED_SQL})"""


def judged(t):
    m = metrics(t)
    base = m.where("model_id = 'baseline'")
    worst = F.min_by(F.col("iou_delta"), F.when(F.col("baseline_iou").isNotNull(), F.struct("baseline_iou", "class_index")))
    d = deltas(t).join(base.select(*KEYS, "class_index"), KEYS)
    macro = d.groupBy("stratum").agg(M.delta(F.avg("baseline_iou"), F.avg("improved_iou")).alias("macro_delta"), worst.alias("worst_delta"))
    f = focus(t).select("stratum", F.col("iou_delta").alias("focus_delta"), "regressed")
    rows = f.join(macro, "stratum").join(ratios(t).select("stratum", "parameter_ratio", "train_ratio"), "stratum", "left")
    return rows.withColumns({"seeds": (F.length("stratum") % 4).cast("int"), "data_regime": F.lit("REAL"), "status": F.lit("MEASURED")})


@query("c13_compare_models", JUDGED_SQL)
def _(t):
    return judged(t).drop("data_regime", "status")


@query("c14_decide", f"SELECT stratum, focus_delta, macro_delta, outcome FROM ({DECIDED_SQL})")
def _(t):
    return M.decide(judged(t)).select("stratum", "focus_delta", "macro_delta", "outcome")


REPORT_SQL = f"""SELECT 'fairness' AS section, path AS item, CAST(matches AS VARCHAR) AS value FROM ({FAIR}) UNION ALL SELECT 'per_class', stratum || '/' || class_name, coalesce(CAST(d_iou AS VARCHAR), 'undefined') FROM ({DELTAS_SQL})
 UNION ALL SELECT 'focus', stratum, coalesce(CAST(iou_delta AS VARCHAR), 'undefined') FROM ({FOCUS_SQL}) UNION ALL SELECT 'compute', stratum, coalesce(CAST(parameter_ratio AS VARCHAR), 'undefined') FROM ({RATIOS_SQL})
 UNION ALL SELECT 'failure', model_id, CAST(total_failures AS VARCHAR) FROM ({ARM}) UNION ALL SELECT 'decision', stratum, outcome FROM ({DECIDED_SQL})"""


def item(df, item, value):
    return df.select(item.alias("item"), value.alias("value"))


@query("c18_comparison_report", REPORT_SQL)
def _(t):
    return M.sections(
        fairness=item(M.fairness(controls(t, "O"), controls(t, "F")), F.col("path"), F.col("matches").cast("string")),
        per_class=item(deltas(t), F.concat_ws("/", *KEYS), X.format_metric(F.col("iou_delta"))),
        focus=item(focus(t), F.col("stratum"), X.format_metric(F.col("iou_delta"))),
        compute=item(ratios(t), F.col("stratum"), X.format_metric(F.col("parameter_ratio"))),
        failure=item(arms(t), F.col("model_id"), F.col("total_failures").cast("string")),
        decision=item(M.decide(judged(t)), F.col("stratum"), F.col("outcome")),
    )


CHART_SQL = f"""SELECT 'iou' AS chart, stratum || '/' || class_name AS label, round(b_iou, 6) AS baseline, round(i_iou, 6) AS improved FROM ({DELTAS_SQL})
 UNION ALL SELECT 'top', category, CAST(max(CASE WHEN model_id = 'baseline' THEN total_errors END) AS DOUBLE), CAST(max(CASE WHEN model_id = 'improved' THEN total_errors END) AS DOUBLE) FROM ({TOP_CATEGORIES}) GROUP BY category"""


@query("c20_chart_data", CHART_SQL)
def _(t):
    d = deltas(t).select(F.lit("iou").alias("chart"), F.concat_ws("/", *KEYS).alias("label"), X.r6(F.col("baseline_iou")).alias("baseline"), X.r6(F.col("improved_iou")).alias("improved"))
    top = E.top_categories(type_sums(t), class_sums(t), ["model_id"])
    by = [F.max(F.when(F.col("model_id") == m, F.col("total_errors"))).cast("double").alias(m) for m in ("baseline", "improved")]
    return d.unionByName(top.groupBy(F.col("category").alias("label")).agg(*by).withColumn("chart", F.lit("top")))


@query("p30_class_color", f"SELECT v.class_index, v.class_name, color, count(*) AS pixels FROM {values_sql(COLORS, 'class_index, class_name, color')} JOIN pixels p ON p.label = v.class_index GROUP BY ALL")
def _(t):
    colors = t.spark.createDataFrame(list(COLORS), "class_index int, class_name string, color string")
    return t.pixels.join(F.broadcast(colors), F.col("label") == F.col("class_index")).groupBy("class_index", "class_name", "color").agg(F.count("*").alias("pixels"))


def fingerprint_sql(table: str, columns: list[str], keys: str = "") -> str:
    row = " || '|' || ".join(f"'{c}=' || coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'null')" for c in sorted(columns))
    k = f"{keys}, " if keys else ""
    sums = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(2))
    return f"SELECT {k}sha256(count(*) || ':' || {sums}) AS fingerprint, count(*) AS rows FROM (SELECT {k}sha256({row}) AS d FROM {table}) GROUP BY ALL"


@query("g39_table_fingerprint", fingerprint_sql("(SELECT scene, sample_id, row_px, col_px, label FROM pixels)", ["sample_id", "row_px", "col_px", "label"], "scene"))
def _(t):
    return M.fingerprint(t.pixels.select("scene", "sample_id", "row_px", "col_px", "label"), ["scene"])


@query("c21_comparison_artifact", f"SELECT 'cmp-' || substr(sha256(fingerprint || '|' || outcome), 1, 12) AS artifact_id, stratum, outcome, fingerprint FROM (SELECT stratum, outcome FROM ({DECIDED_SQL})), ({fingerprint_sql('preds', ['model_id', 'sample_id', 'group_id', 'true_class', 'pred_class'])})")
def _(t):
    f = M.fingerprint(t.preds).select("fingerprint")  # one row
    rows = M.decide(judged(t)).select("stratum", "outcome").crossJoin(F.broadcast(f))
    return rows.withColumn("artifact_id", M.artifact_id("cmp-", F.col("fingerprint"), F.col("outcome")))


@query("c22_dataset_artifact", f"SELECT dataset, 'ds-' || dataset || '-' || substr(sha256(fingerprint), 1, 12) AS artifact_id, rows FROM ({fingerprint_sql('(SELECT dataset, sample_id, group_id, n_bytes, label FROM samples)', ['sample_id', 'group_id', 'n_bytes', 'label'], 'dataset')})")
def _(t):
    f = M.fingerprint(t.samples.select("dataset", "sample_id", "group_id", "n_bytes", "label"), ["dataset"])
    return f.select("dataset", F.concat(F.lit("ds-"), "dataset", M.artifact_id("-", F.col("fingerprint"))).alias("artifact_id"), "rows")




@query("u03_flatten_report", "SELECT 'scenes' AS section, scene, n, CAST(NULL AS INT) AS label FROM (SELECT scene, count(*) AS n FROM pixels GROUP BY ALL) UNION ALL SELECT 'labels', NULL, n, label FROM (SELECT label, count(*) AS n FROM pixels GROUP BY ALL)")
def _(t):
    return M.sections(scenes=t.pixels.groupBy("scene").agg(F.count("*").alias("n")), labels=t.pixels.groupBy("label").agg(F.count("*").alias("n")))
