"""Queries on confidence intervals of metrics and of differences between models."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.exprs import r6
from evalframe.functions.vocab import classes
from evalframe.operators import bootstrap as B
from evalframe.queries.evaluation import CLASS_TABLE, METRICS_SQL
from evalframe.queries.fixtures import query

REPLICATES = 40
_BLOCKS = -(-REPLICATES // B.PER_DIGEST)
_WEIGHT = " + ".join(f"CASE WHEN u >= {b} THEN 1 ELSE 0 END" for b in B.poisson_bounds())
#: 32 bits of a digest of sample and block for each replicate; replicate -1 is the data as they are.
_DRAWS = f"""ids AS (SELECT DISTINCT sample_id FROM preds),
 draws AS (SELECT sample_id, block * {B.PER_DIGEST} + i AS replicate, CAST('0x' || substr(d, CAST(i * 8 + 1 AS INT), 8) AS BIGINT) AS u FROM
  (SELECT sample_id, block, sha256(concat('0|', sample_id, '|', block)) AS d, unnest(range({B.PER_DIGEST})) AS i FROM (SELECT sample_id, unnest(range({_BLOCKS})) AS block FROM ids))),
 weights AS (SELECT sample_id, replicate, {_WEIGHT} AS w FROM draws UNION ALL SELECT sample_id, -1, 1 FROM ids)"""
_METRICS = ("iou", "dice", "precision", "recall", "f1")


def _values(conf: str, keys: str) -> str:
    """Metrics of each class and of all classes, by row, of the confusion tables in ``conf``."""
    on = " AND ".join(f"c.{k} = t.{k}" for k in keys.split(", "))
    return f"""counts AS (SELECT {', '.join(f't.{k}' for k in keys.split(', '))}, k.class_name, coalesce(sum(CASE WHEN true_class = class_index AND pred_class = class_index THEN n END), 0) AS tp,
  coalesce(sum(CASE WHEN true_class <> class_index AND pred_class = class_index THEN n END), 0) AS fp, coalesce(sum(CASE WHEN true_class = class_index AND pred_class <> class_index THEN n END), 0) AS fn,
  sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END) / sum(n) AS accuracy FROM (SELECT DISTINCT {keys} FROM {conf}) t CROSS JOIN {CLASS_TABLE} k JOIN {conf} c ON {on} GROUP BY ALL),
 metrics AS (SELECT *, {METRICS_SQL} FROM counts),
 long AS ({' UNION ALL '.join(f"SELECT {keys}, class_name, '{m}' AS metric, {m} AS value FROM metrics" for m in _METRICS)}
  UNION ALL {' UNION ALL '.join(f"SELECT {keys}, '__all__', '{m}', avg({m}) FROM metrics GROUP BY {keys}" for m in (*_METRICS, 'accuracy'))})"""


def _spread(value: str, table: str, keys: str) -> str:
    q = [f"round(quantile_cont(CASE WHEN replicate >= 0 THEN {value} END, {p}), 6)" for p in ((1 - B.LEVEL) / 2, 1 - (1 - B.LEVEL) / 2)]
    return f"SELECT {keys}, round(max(CASE WHEN replicate = -1 THEN {value} END), 6) AS {value}, {q[0]} AS low, {q[1]} AS high, count(CASE WHEN replicate >= 0 THEN {value} END) AS defined FROM {table} GROUP BY {keys}"


INTERVALS = f"""WITH {_DRAWS},
 conf AS (SELECT CASE WHEN grouping(group_id) = 1 THEN '__overall__' ELSE group_id END AS stratum, model_id, replicate, true_class, pred_class, sum(w) AS n FROM preds JOIN weights USING (sample_id) WHERE w > 0
  GROUP BY GROUPING SETS ((group_id, model_id, replicate, true_class, pred_class), (model_id, replicate, true_class, pred_class))),
 {_values('conf', 'stratum, model_id, replicate')} {_spread('value', 'long', 'stratum, model_id, class_name, metric')}"""
DELTAS = f"""WITH {_DRAWS},
 conf AS (SELECT model_id, replicate, true_class, pred_class, sum(w) AS n FROM preds JOIN weights USING (sample_id) WHERE w > 0 GROUP BY ALL),
 {_values('conf', 'model_id, replicate')},
 deltas AS (SELECT class_name, metric, replicate, max(CASE WHEN model_id = 'improved' THEN value END) - max(CASE WHEN model_id = 'baseline' THEN value END) AS delta FROM long GROUP BY ALL) {_spread('delta', 'deltas', 'class_name, metric')}"""


def rounded(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@query("g46_metric_intervals", INTERVALS)
def _(t):
    return rounded(B.metric_intervals(t.preds, ["model_id"], "group_id", classes(t.spark), replicates=REPLICATES), "value", "low", "high")


@query("g47_delta_intervals", DELTAS)
def _(t):
    return rounded(B.paired_intervals(t.preds, "model_id", ("baseline", "improved"), classes(t.spark), replicates=REPLICATES), "delta", "low", "high")
