"""Places, running sums, calibration and AUC against sorted computations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.operators import calibration as K
from evalframe.operators import ordered as O
from evalframe.operators import ranking as R


def test_positions_of_ids_that_begin_alike(spark):
    n, parts = 1_000_000, 300
    ids = spark.range(n).select(F.format_string("sample-000000-%09d", (F.col("id") * 7919) % n).alias("sample_id"), F.lit("HIGH").alias("severity"), F.lit(0.5).alias("error_rate"), F.lit(3).alias("error_count"))
    order = R.canonical_order()
    most = O.arranged(ids, order, parts).groupBy("_part").count().agg(F.max("count")).first()[0]
    assert most <= n // 100
    ranked = R.rank_samples(ids, partitions=parts)
    assert ranked.where(F.col("rank") != F.substring("sample_id", 15, 9).cast("int") + 1).count() == 0 and ranked.count() == n


def test_positions_split_equal_rows(spark):
    df = spark.range(60_000).select(F.lit(1).alias("x")).repartition(8)
    placed = O.arranged(df, [F.col("x")], 200)
    assert placed.groupBy("_part").count().agg(F.max("count")).first()[0] < 2000
    got = O.with_positions(df, [F.col("x")], partitions=200)
    assert got.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (1, 60_000, 60_000)
    assert O.with_positions(df.limit(0), [F.col("x")]).count() == 0


def test_positions_of_each_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), rng.randint(0, 30), i) for i in range(2000)]
    got = O.with_positions(spark.createDataFrame(rows, "k string, x int, i int"), [F.col("x").desc(), F.col("i")], partitions=9, by=["k"])
    want, seen = {}, {}
    for k, x, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert {r.i: r["rank"] for r in got.collect()} == want


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_sums_equal_a_loop(spark, parts):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 5, 5]), i, rng.randint(-4, 9), rng.choice([None, 1.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, n long, m double").repartition(5)
    got = {r.b: (r.n_before, r.m_before) for r in O.with_prefix_sums(df, [F.col("a").desc_nulls_last(), F.col("b")], ["n", "m"], parts).collect()}
    n, m, want = 0, 0.0, {}
    for a, b, x, y in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])):
        want[b] = (n, m)
        n, m = n + x, m + (y or 0)
    assert got == want


def softmax(x, t):
    e = np.exp(np.array(x, float) / t - max(x) / t)
    return e / e.sum()


def test_calibration_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 3, [float(v) for v in rng.normal(size=4)], int(rng.integers(4))) for i in range(900)] + [(0, None, 1), (0, [1.0, 2.0, 0.0, 0.0], None), (1, [0.0, 900.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "k int, logits array<double>, label int")
    known = [(k, softmax(x, 0.5), y) for k, x, y in rows if x is not None and y is not None]
    c = K.confident(df, temperature=0.5)
    h = K.reliability(c, ["k"], bins=5)
    got = {r.k: r for r in K.calibration_error(h, ["k"]).collect()}
    merged = K.calibration_error(K.merge_reliability([h.where("k < 2"), h.where("k = 2")], []), []).first()
    for key, r in [*got.items(), (None, merged)]:
        own = [(p.max(), p.argmax() == y) for k, p, y in known if key is None or k == key]
        conf, right = np.array([x[0] for x in own]).round(9), np.array([x[1] for x in own])
        bins = np.minimum((conf * 5).astype(int), 4)
        gaps = [(abs(right[bins == b].mean() - conf[bins == b].mean()), (bins == b).mean()) for b in set(bins)]
        assert np.allclose([r.accuracy, r.confidence, r.ece, r.mce], [right.mean(), conf.mean(), sum(g * w for g, w in gaps), max(g for g, _ in gaps)]) and r.n == len(own)
    wrong = [p.max().round(9) for _, p, y in known if p.argmax() != y]
    e = K.confidence_errors(c, [], 0.7, 0.4).first()
    assert e[:] == (len(known), len(wrong), sum(x >= 0.7 for x in wrong), sum(x < 0.4 for x in wrong))


def test_auc_equals_all_pairs(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([0.5, 0.5, rng.random(), rng.randint(0, 5) / 5, None]), rng.random() < 0.3 + k / 5) for k in range(3) for _ in range(300)]
    rows += [(7, 0.2, True), (8, None, False), (9, 0.1, False), (9, 0.3, False)]
    got = {r.k: r for r in K.auc(spark.createDataFrame(rows, "k int, s double, y boolean"), ["k"], "s", "y", partitions=5).collect()}
    for k in range(3):
        pos, neg = ([s for q, s, y in rows if q == k and s is not None and y == want] for want in (True, False))
        won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert got[k].auc == pytest.approx(won / len(pos) / len(neg), abs=1e-12) and (got[k].positives, got[k].negatives) == (len(pos), len(neg))
    assert got[7].auc is None and got[9].auc is None and 8 not in got
    df = spark.createDataFrame([(1, [0.1, 0.9], 1), (2, [0.8, 0.2], 0), (3, [0.4, 0.6], 0)], "i int, logits array<double>, label int")
    assert {r.class_index: r.auc for r in K.auc(K.class_scores(df), ["class_index"], "score", "positive").collect()} == {0: 1.0, 1: 1.0}


def test_rows_that_share_a_key_stay_spread(spark):
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        df = spark.range(4000).select(F.lit("one").alias("k"), F.col("id").alias("x"))
        got = O.with_positions(df, [F.col("x")], partitions=40, by=["k"])
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 4000 and max(tasks) < 1000  # all 4,000 met in one task when they were joined by key
        assert got.where("rank <> x + 1").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
