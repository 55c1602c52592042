"""Queries on predictions: their tasks follow from the rows, and their results stay those of their SQL."""

from __future__ import annotations

import uuid

import pytest

from evalframe import queries as library
from evalframe.queries import fixtures
from tests.oracle import DATA, assert_same, connection

#: By finding of round 3.
QUERIES = {
    "F5": "t02_topk_count",
    "F6": "t07_topk_per_group",
    "F7": "c11_sample_failures",
    "F8": "w02_dedup_worst",
    "F9": "t03_topk_class",
    "F11": "p19_failure_categories",
    "F18": "w05_dominant_sample_confusion",
    "F12": "p20_measurability",
    "F14": "g27_error_type_summary",
    "F10": "p35_measured_taxonomy",
    "F15": "c12_analyze_failures",
}


@pytest.mark.parametrize("name", QUERIES.values(), ids=QUERIES)
def test_tasks_follow_from_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100, raising=False)
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, name)
    try:
        assert_same(spark, connection(), library.all_queries()[name], library.all_sql()[name])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    stages = [s for j in seen.getJobIdsForGroup(group) for i in seen.getJobInfo(j).stageIds if (s := seen.getStageInfo(i))]
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert max(s.numTasks for s in stages) >= rows / 100  # 4 shuffle partitions, joined to fewer, without the rows' number
