"""Queries on predictions: confusion counts, metrics, strata, and label expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import exprs as X
from evalframe.functions.vocab import CLASSES, FOCUS_CLASS, classes, values_sql
from evalframe.operators import confusion as C
from evalframe.queries.fixtures import query

NAMES = dict(CLASSES)
CLASS_TABLE = f"(SELECT * FROM {values_sql(CLASSES, 'class_index, class_name')})"
CONF = "SELECT model_id, true_class, pred_class, count(*) AS n FROM preds GROUP BY ALL"
GROUPED = "SELECT model_id, group_id, true_class, pred_class, count(*) AS n FROM preds GROUP BY ALL"


def counts_sql(conf: str, keys: str) -> str:
    """tp, fp, fn, tn, support and total of each class and key from a confusion subquery."""
    on = " AND ".join(f"c.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {sel}, k.class_index, k.class_name, CAST(coalesce(sum(CASE WHEN true_class = class_index AND pred_class = class_index THEN n END), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(CASE WHEN true_class <> class_index AND pred_class = class_index THEN n END), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(CASE WHEN true_class = class_index AND pred_class <> class_index THEN n END), 0) AS BIGINT) AS fn,
  CAST(coalesce(sum(CASE WHEN true_class <> class_index AND pred_class <> class_index THEN n END), 0) AS BIGINT) AS tn,
  CAST(coalesce(sum(CASE WHEN true_class = class_index THEN n END), 0) AS BIGINT) AS support, CAST(sum(n) AS BIGINT) AS total
  FROM (SELECT DISTINCT {keys} FROM ({conf})) t CROSS JOIN {CLASS_TABLE} k JOIN ({conf}) c ON {on} GROUP BY ALL"""


IOU = "tp / nullif(tp + fp + fn, 0)"
DICE = "2 * tp / nullif(2 * tp + fp + fn, 0)"
PREC, REC = "tp / nullif(tp + fp, 0)", "tp / nullif(tp + fn, 0)"
F1 = f"2 * ({PREC}) * ({REC}) / nullif(({PREC}) + ({REC}), 0)"
FORMULA = {"iou": IOU, "dice": DICE, "precision": PREC, "recall": REC, "f1": F1}
METRICS_SQL = ", ".join(f"{f} AS {m}" for m, f in FORMULA.items())
ROUNDED = ", ".join(f"round({f}, 6) AS {m}" for m, f in FORMULA.items())
COUNTS = counts_sql(CONF, "model_id")
METRIC_TABLE = f"SELECT *, {METRICS_SQL} FROM ({COUNTS})"


def rounded(df, columns=C.METRICS):
    return df.withColumns({c: X.r6(F.col(c)) for c in columns})


def conf(t, keys=("model_id",)):
    return C.confusion(t.preds, list(keys), 4)


def counts(t, keys=("model_id",)):
    return C.class_counts(conf(t, keys), list(keys), classes(t.spark))


@query("g01_confusion", GROUPED)
def _(t):
    return conf(t, ("model_id", "group_id"))


@query("g02_confusion_merge", "SELECT true_class, pred_class, count(*) AS n FROM preds GROUP BY ALL")
def _(t):
    parts = [C.confusion(t.preds.where(F.col("model_id") == m), [], 4) for m in ("baseline", "improved")]
    return C.merge(*parts)


@query("g03_class_counts", f"SELECT model_id, class_name, tp, fp, fn, tn, support, tp + fp AS predicted, total FROM ({COUNTS})")
def _(t):
    return counts(t).select("model_id", "class_name", "tp", "fp", "fn", "tn", "support", "predicted", "total")


@query("g04_class_metrics", f"""SELECT model_id, class_name, metric, round(value, 6) AS value, value IS NOT NULL AS defined, CASE WHEN value IS NULL THEN 'zero denominator' ELSE '' END AS reason
FROM ({" UNION ALL ".join(f"SELECT model_id, class_name, '{m}' AS metric, {f} AS value FROM ({COUNTS})" for m, f in FORMULA.items())})""")
def _(t):
    return rounded(C.metric_rows(C.class_metrics(counts(t)), ["model_id", "class_name"]), ["value"])


@query("g05_pixel_accuracy", "SELECT model_id, group_id, round(sum(CASE WHEN true_class = pred_class THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM preds GROUP BY ALL")
def _(t):
    return rounded(C.pixel_accuracy(conf(t, ("model_id", "group_id")), ["model_id", "group_id"]), ["accuracy"])


@query("g06_macro", f"SELECT model_id, {', '.join(f'round(avg({m}), 6) AS {m}, count({m}) || {chr(39)}/{chr(39)} || count(*) AS {m}_classes' for m in FORMULA)} FROM ({METRIC_TABLE}) GROUP BY ALL")
def _(t):
    return rounded(C.macro(C.class_metrics(counts(t)), ["model_id"]))


@query("g07_weighted", f"SELECT model_id, {', '.join(f'round(sum({m} * support) / nullif(sum(CASE WHEN {m} IS NOT NULL THEN support END), 0), 6) AS {m}' for m in FORMULA)} FROM ({METRIC_TABLE}) GROUP BY ALL")
def _(t):
    return rounded(C.weighted(C.class_metrics(counts(t)), ["model_id"]))


@query("g08_micro", f"SELECT model_id, {ROUNDED} FROM (SELECT model_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({COUNTS}) GROUP BY ALL)")
def _(t):
    return rounded(C.micro(counts(t), ["model_id"])).select("model_id", *C.METRICS)


@query("g09_eval_summary", f"""SELECT m.model_id, round(any_value(accuracy), 6) AS accuracy, round(avg(iou), 6) AS macro_iou, round(avg(f1), 6) AS macro_f1,
  round(max(CASE WHEN class_name = '{FOCUS_CLASS}' THEN iou END), 6) AS focus_iou, arg_min(class_name, iou) AS worst_class FROM ({METRIC_TABLE}) m
  JOIN (SELECT model_id, sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END) / sum(n) AS accuracy FROM ({CONF}) GROUP BY ALL) a ON a.model_id = m.model_id GROUP BY ALL""")
def _(t):
    out = C.summary(conf(t), ["model_id"], classes(t.spark), FOCUS_CLASS)
    return rounded(out, ["accuracy", "macro_iou", "macro_f1", "focus_iou"])


STRATA = f"SELECT group_id AS stratum, model_id, true_class, pred_class, n FROM ({GROUPED}) UNION ALL SELECT '__overall__', model_id, true_class, pred_class, n FROM ({CONF})"


def strata_metrics(t, table=None):
    table = C.strata(conf(t, ("model_id", "group_id")) if table is None else table, "group_id", ["model_id"])
    keys = ["model_id", "stratum"]
    return rounded(C.class_metrics(C.class_counts(table, keys, classes(t.spark)))).select(*keys, "class_name", *C.METRICS)


STRATA_METRICS = f"SELECT model_id, stratum, class_name, {ROUNDED} FROM ({counts_sql(STRATA, 'model_id, stratum')})"


@query("g10_stratified_eval", STRATA_METRICS)
def _(t):
    return strata_metrics(t)


@query("g11_strata_from_confusions", f"SELECT stratum, model_id, true_class, pred_class, n FROM ({STRATA})")
def _(t):
    return C.strata(conf(t, ("model_id", "group_id")), "group_id", ["model_id"])


@query("g12_class_view", f"SELECT model_id, class_name, round({IOU}, 6) AS iou, round({REC}, 6) AS recall FROM ({COUNTS})")
def _(t):
    view = C.class_view(C.class_metrics(counts(t)), ["model_id"])
    out = view.select("model_id", F.explode("classes").alias("class_name", "m")).select("model_id", "class_name", "m.iou", "m.recall")
    return rounded(out, ["iou", "recall"])


@query("j10_class_scaffold", f"""SELECT g.group_id, t.class_index AS true_class, p.class_index AS pred_class, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT group_id FROM preds) g CROSS JOIN {CLASS_TABLE} t CROSS JOIN {CLASS_TABLE} p
LEFT JOIN (SELECT group_id, true_class, pred_class, count(*) AS n FROM preds GROUP BY ALL) c ON c.group_id = g.group_id AND c.true_class = t.class_index AND c.pred_class = p.class_index""")
def _(t):
    return C.scaffold(C.confusion(t.preds, ["group_id"]), ["group_id"], classes(t.spark))


@query("c09_evaluate", f"SELECT model_id, class_name, support, {ROUNDED} FROM ({COUNTS})")
def _(t):
    return rounded(C.evaluate(t.preds, ["model_id"], classes(t.spark))).select("model_id", "class_name", "support", *C.METRICS)


@query("c16_evaluation_report", f"""SELECT 'per_class' AS section, model_id, '' AS stratum, class_name AS item, coalesce(CAST(round({IOU}, 6) AS VARCHAR), 'undefined') AS value FROM ({COUNTS})
UNION ALL SELECT 'by_group', model_id, stratum, class_name, coalesce(CAST(round({IOU}, 6) AS VARCHAR), 'undefined') FROM ({counts_sql(STRATA, 'model_id, stratum')})
UNION ALL SELECT 'confusion', model_id, '', true_class || '->' || pred_class, CAST(n AS VARCHAR) FROM ({CONF})
UNION ALL SELECT 'overall', model_id, '', 'accuracy', CAST(round(sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END) / sum(n), 6) AS VARCHAR) FROM ({CONF}) GROUP BY ALL""")
def _(t):
    def section(name, df, stratum, item, value):
        return df.select(F.lit(name).alias("section"), "model_id", stratum.alias("stratum"), item.alias("item"), value.alias("value"))

    c = conf(t)
    wide = C.pivoted(c, ["model_id"], [0, 1, 2, 3])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.col(f"pred_{i}").alias("n")) for i in range(4)])).alias("c")
    none = F.lit("")
    return (
        section("per_class", C.class_metrics(counts(t)), none, F.col("class_name"), X.format_metric(F.col("iou")))
        .unionByName(section("by_group", strata_metrics(t), F.col("stratum"), F.col("class_name"), X.format_metric(F.col("iou"))))
        .unionByName(section("confusion", wide.select("model_id", "true_class", cells), none, F.concat_ws("->", "true_class", "c.p"), F.col("c.n").cast("string")).where("value <> '0'"))
        .unionByName(section("overall", C.pixel_accuracy(c, ["model_id"]), none, F.lit("accuracy"), X.format_metric(F.col("accuracy"))))
    )


@query("u01_union_batches", "SELECT true_class, pred_class, count(*) AS n FROM preds GROUP BY ALL")
def _(t):
    batches = [t.preds.where(F.col("group_id") == g) for g in ("1-URGENT", "2-HIGH")] + [t.preds.where(~F.col("group_id").isin("1-URGENT", "2-HIGH"))]
    return C.merge(*[C.confusion(b, []) for b in batches])


@query("p01_collapse_binary", "SELECT model_id, CASE WHEN true_class IN (1, 2) THEN 1 ELSE 0 END AS true_class, CASE WHEN pred_class IN (1, 2) THEN 1 ELSE 0 END AS pred_class, count(*) AS n FROM preds GROUP BY ALL")
def _(t):
    return C.confusion(t.preds.withColumns({c: X.collapse_binary(F.col(c)) for c in ("true_class", "pred_class")}), ["model_id"], 2)


@query("p02_argmax", "SELECT vec_id, label, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS pred_class FROM logits")
def _(t):
    return t.logits.select("vec_id", "label", X.argmax(F.col("logits")).alias("pred_class"))


@query("p17_class_name", "SELECT vec_id, CASE label WHEN 0 THEN 'clear' WHEN 1 THEN 'thick_cloud' WHEN 2 THEN 'thin_cloud' WHEN 3 THEN 'cloud_shadow' ELSE 'class_' || label END AS class_name FROM logits")
def _(t):
    return t.logits.select("vec_id", X.class_name(F.col("label"), NAMES).alias("class_name"))


@query("p22_ignore_label", "SELECT model_id, true_class, pred_class, count(*) AS n FROM preds WHERE true_class <> 3 GROUP BY ALL")
def _(t):
    return C.confusion(t.preds, ["model_id"], ignore=3)


@query("p23_label_range_check", "SELECT vec_id, true_class, pred_class FROM (SELECT vec_id, label AS true_class, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS pred_class FROM logits) WHERE true_class <> 9 AND (true_class > 3 OR pred_class > 3 OR true_class < 0)")
def _(t):
    rows = t.logits.select("vec_id", F.col("label").alias("true_class"), X.argmax(F.col("logits")).alias("pred_class"))
    return C.label_violations(rows, 4, ignore=9)


@query("p27_format_metric", f"SELECT model_id, class_name, coalesce(CAST(round({F1}, 6) AS VARCHAR), 'undefined') AS f1 FROM ({COUNTS})")
def _(t):
    return C.class_metrics(counts(t)).select("model_id", "class_name", X.format_metric(F.col("f1")).alias("f1"))
