"""Queries on change between acquisitions: as-of pairs, transition matrices, errors of change."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.exprs import r6
from evalframe.operators import change as D
from evalframe.queries.fixtures import query

#: Days between two acquisitions of a pair at least, and beyond these at most; days of a bucket.
GAP, TOLERANCE, BUCKET = 30, 180, 90
PAIRS = f"""SELECT a.*, b.day AS before_day, b.true_class AS before_true_class, b.pred_class AS before_pred_class
 FROM acquisitions a ASOF JOIN (SELECT *, day + {GAP} AS until FROM acquisitions) b ON a.tile_id = b.tile_id AND a.day >= b.until WHERE a.day - {GAP} - b.day <= {TOLERANCE}"""


def pairs(t):
    return D.change_pairs(t.acquisitions, "tile_id", "day", ["true_class", "pred_class"], BUCKET, GAP, TOLERANCE)


@query("j14_as_of_pairs", PAIRS)
def _(t):
    return pairs(t)


@query("g48_transitions", f"SELECT *, round(n / sum(n) OVER (PARTITION BY season, from_class), 6) AS share FROM (SELECT CAST(day // 91 % 4 AS INT) AS season, before_true_class AS from_class, true_class AS to_class, count(*) AS n FROM ({PAIRS}) GROUP BY ALL)")
def _(t):
    rows = pairs(t).withColumn("season", (F.floor(F.col("day") / 91) % 4).cast("int"))
    return D.transitions(rows, ["season"], "true_class").withColumn("share", r6(F.col("share")))


@query("g49_change_errors", f"""SELECT CAST((true_class <> pred_class) AS INT) + CAST((before_true_class <> before_pred_class) AS INT) AS wrong_masks, count(*) AS n, count(CASE WHEN real AND found THEN 1 END) AS tp,
 count(CASE WHEN NOT real AND found THEN 1 END) AS fp, count(CASE WHEN real AND NOT found THEN 1 END) AS fn, count(CASE WHEN NOT real AND NOT found THEN 1 END) AS tn
 FROM (SELECT *, true_class <> before_true_class AS real, pred_class <> before_pred_class AS found FROM ({PAIRS})) GROUP BY ALL""")
def _(t):
    return D.change_errors(pairs(t), [], "true_class", "pred_class")
