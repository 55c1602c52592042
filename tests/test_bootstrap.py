"""Bootstrap intervals against numpy."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.functions.vocab import CLASSES, classes
from evalframe.operators import bootstrap as B

ROWS = "model_id string, group_id string, sample_id string, true_class int, pred_class int"


def weight(sample, replicate, seed=0):
    block, i = divmod(replicate, 8)
    u = int(hashlib.sha256(f"{seed}|{sample}|{block}".encode()).hexdigest()[8 * i : 8 * i + 8], 16)
    return sum(u >= b for b in B.poisson_bounds())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = []
    for s in range(60):
        for m in ("a", "b"):
            for _ in range(rng.randint(1, 12)):
                t = rng.choice([0, 0, 1, 3])
                made.append((m, None if s % 9 == 0 else "gh"[s % 2], f"s{s}", t, t if rng.random() < (0.6 if m == "a" else 0.8) else rng.randint(0, 3)))
    return made


def metrics(counted):
    """{(class, metric): value} of weighted (true, predicted) counts; undefined ones are left out."""
    m = np.zeros((4, 4))
    for (t, p), n in counted.items():
        m[t, p] += n
    out, defined = {}, {}
    for i, name in CLASSES:
        tp, fp, fn = m[i, i], m[:, i].sum() - m[i, i], m[i].sum() - m[i, i]
        ratio = lambda a, b: a / b if b else None
        p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
        own = {"iou": ratio(tp, tp + fp + fn), "dice": ratio(2 * tp, 2 * tp + fp + fn), "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r) if p is not None and r is not None else None}
        for k, v in own.items():
            if v is not None:
                out[name, k] = v
                defined.setdefault(k, []).append(v)
    out |= {("__all__", k): float(np.mean(v)) for k, v in defined.items()}
    if m.sum():
        out["__all__", "accuracy"] = np.trace(m) / m.sum()
    return out


def drawn(rows, replicate, keep):
    c = Counter()
    for r in rows:
        if keep(r) and (w := 1 if replicate is None else weight(r[2], replicate)):
            c[r[3:]] += w
    return c


def test_weights_are_poisson(spark):
    ids = spark.range(4000).select(F.col("id").cast("string").alias("sample_id"))
    got = {(r.sample_id, r.replicate): r.weight for r in B.replicate_weights(ids, "sample_id", 11).collect()}
    assert all(got.get((str(s), r), 0) == weight(s, r) for s in range(4000) for r in range(11))
    seen = Counter(got.get((str(s), r), 0) for s in range(4000) for r in range(11))
    for k in range(5):
        assert abs(seen[k] / 44_000 - math.exp(-1) / math.factorial(k)) < 0.01
    other = {(r.sample_id, r.replicate): r.weight for r in B.replicate_weights(ids, "sample_id", 11, seed=5).collect()}
    assert other != got


def test_intervals_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    got = {(r.stratum, r.model_id, r.class_name, r.metric): r for r in B.metric_intervals(df, ["model_id"], "group_id", classes(spark), replicates=19, level=0.9).collect()}
    for stratum in ("__overall__", "g", "h", "_ungrouped"):
        for model in ("a", "b"):
            keep = lambda r: r[0] == model and stratum in ("__overall__", r[1] or "_ungrouped")  # noqa: B023, E731
            point, draws = metrics(drawn(rows, None, keep)), [metrics(drawn(rows, i, keep)) for i in range(19)]
            for name in [*dict(CLASSES).values(), "__all__"]:
                for metric in ("iou", "dice", "precision", "recall", "f1", *(["accuracy"] if name == "__all__" else [])):
                    r, values = got.pop((stratum, model, name, metric)), [d[name, metric] for d in draws if (name, metric) in d]
                    assert (r.value is None) == ((name, metric) not in point) and r.defined == len(values)
                    if values:
                        assert np.allclose([r.low, r.high], np.quantile(values, [0.05, 0.95]), atol=1e-12)
                    else:
                        assert r.low is None and r.high is None
                    assert r.value is None or abs(r.value - point[name, metric]) < 1e-12
    assert not got


def test_intervals_do_not_depend_on_the_arrangement(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    made = [sorted(map(repr, B.metric_intervals(d, ["model_id"], None, classes(spark), replicates=9).collect())) for d in (df, df.repartition(7).orderBy("pred_class"))]
    assert made[0] == made[1] and len(made[0]) == 2 * 26


def test_paired_intervals(spark, rows):
    got = {(r.class_name, r.metric): r for r in B.paired_intervals(spark.createDataFrame(rows, ROWS), "model_id", ("a", "b"), classes(spark), replicates=19).collect()}
    draws = [[metrics(drawn(rows, i, lambda r, m=m: r[0] == m)) for m in "ab"] for i in range(19)]
    for key in (("clear", "iou"), ("__all__", "accuracy"), ("cloud_shadow", "recall")):
        values = [b[key] - a[key] for a, b in draws if key in a and key in b]
        assert np.allclose([got[key].low, got[key].high], np.quantile(values, [0.025, 0.975]), atol=1e-12) and got[key].defined == len(values)
    assert got["__all__", "accuracy"].low < got["__all__", "accuracy"].delta < got["__all__", "accuracy"].high
    assert B.metric_intervals(spark.createDataFrame([], ROWS), ["model_id"], "group_id", classes(spark), replicates=8).count() == 0


def test_sums_of_many_replicates_beside_the_rows_as_they_are(spark, rows):
    replicates = B.PER_ROW * B.PER_DIGEST + 3  # a second wide row, of which not all sums are asked for
    got = {tuple(r[:-1]): r.n for r in B.replicated_confusion(spark.createDataFrame(rows, ROWS), ["model_id"], replicates=replicates).collect()}
    want = Counter()
    for m, _, s, t, p in rows:
        want[m, -1, t, p] += 1
        for i in range(replicates):
            want[m, i, t, p] += weight(s, i)
    assert got == {k: n for k, n in want.items() if n}
