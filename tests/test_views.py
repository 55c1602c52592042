"""Views over the given tables: over how many tasks they are dealt."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.queries import failures, fixtures
from tests.oracle import DATA


def test_tasks_of_predictions_follow_from_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    t = fixtures.Views(spark, str(DATA))
    rows = [r["count"] for r in t.predictions.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == t.lineitem.count() and max(rows) <= 2 * 500
    # both models' rows of a sample are in one task, before and after they are grouped
    spread = t.preds.select("sample_id", F.spark_partition_id().alias("p")).groupBy("sample_id").agg(F.count_distinct(F.col("p") % len(rows)).alias("n"))
    assert t.preds.count() == 2 * sum(rows) and spread.where("n > 1").count() == 0


def test_records_of_errors_read_predictions_once(spark):
    t = fixtures.Views(spark, str(DATA))
    found, table = failures.records(t), failures.conf(t)
    assert "l_partkey" not in found._jdf.queryExecution().optimizedPlan().toString()  # a stored table of classes squared, not the join
    whole = failures.E.error_records(table, failures.C.class_counts(table, ["model_id"], failures.classes(spark)), ["model_id"], failures.classes(spark))
    assert found.count() > 0 and found.exceptAll(whole).count() == whole.exceptAll(found).count() == 0
