"""Composite jobs on the smallest tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.vocab import CLASSES, FOCUS_CLASS, classes
from evalframe.plans import jobs
from evalframe.queries import datasets, failures
from evalframe.queries.comparison import compute, metrics
from evalframe.queries.fixtures import Views

DATA = "/root/testdata/sf0.001"


def test_evaluate_and_compare(spark):
    t = Views(spark, DATA)
    e = jobs.evaluate(t.preds, classes(spark), FOCUS_CLASS)
    assert e.macro.count() == e.micro.count() == e.weighted.count() == e.summary.count() == 2
    assert sorted(map(str, e.strata.select("model_id", "stratum", "class_name", "tp").collect())) == sorted(map(str, metrics(t).select("model_id", "stratum", "class_name", "tp").collect()))
    rows = jobs.compare_models(metrics(t), compute(t), "baseline", ["improved", "baseline"], FOCUS_CLASS, seeds=3).collect()
    assert {r.outcome for r in rows if r.candidate == "baseline"} == {"NO_SIGNIFICANT_IMPROVEMENT"}
    assert len(rows) == 12
    none = jobs.compare_models(metrics(t), compute(t), "baseline", ["improved"], FOCUS_CLASS, seeds=3, data_regime="SYNTHETIC")
    assert {r.outcome for r in none.collect()} == {"INCONCLUSIVE"}


def test_analyze_failures(spark):
    t = Views(spark, DATA)
    a = jobs.analyze_failures(t.preds, classes(spark), dict(CLASSES), FOCUS_CLASS, "baseline", k=5)
    assert a.ranked.count() == failures.fails(t).count()
    assert a.hard.count() == 20 and a.arms.count() == 2
    assert a.ranked.agg(F.max("rank")).first()[0] == a.ranked.count()
    assert a.by_type.count() == 6 and a.by_class.count() == 8 and a.by_group.count() == 10


def test_prepare_dataset(spark):
    t = Views(spark, DATA)
    labels = t.docs_labelled.where("label is not null").select("dataset", "label")
    p = jobs.prepare_dataset(t.docs_labelled, t.sample_files, t.files_here, t.files_meta, t.files_expected, labels, 2, [1], 2)
    assert p.leaks.count() == 0 and p.splits.count() == t.docs_labelled.count()
    assert p.issues.count() == datasets.issues(t).count()
    assert {r.overall for r in p.status.collect()} <= {"READY", "READY_WITH_WARNINGS", "INCOMPLETE", "INVALID"}
