"""Radix selection against numpy."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.operators import stats as S


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_keys_are_the_bits(spark):
    rng = random.Random(2)
    xs = [0.0, -0.0, 1.0, 2.0, 4.0, 0.5, 1e308, 1.7976931348623157e308, 2.2250738585072014e-308, 2.225073858507201e-308, 5e-324, 1e-310, 3.0, 1e-300]
    for e in range(-1074, 1024):
        p = 2.0**e
        xs += [p, float(np.nextafter(p, np.inf)), float(np.nextafter(p, 0))]
    xs += [struct.unpack("<d", struct.pack("<q", rng.getrandbits(62)))[0] for _ in range(3000)]
    xs = [x for x in xs if np.isfinite(x)]
    xs += [-x for x in xs]
    got = S.with_order_key(spark.createDataFrame([(x,) for x in xs], "x double"), "x", "k").collect()
    assert [r.k for r in got] == [bits(r.x) for r in got]


def test_heavy_tails_keep_cells_small(spark):
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") == 17, 1e12).otherwise(F.pmod(F.col("id") * 7919, F.lit(n)) / 1000.0).alias("x"), F.lit("a").alias("k"))
    own = np.array([i * 7919 % n / 1000.0 for i in range(n) if i != 17] + [1e12])
    points = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = S.exact_percentiles(df, ["k"], "x", points, direct=500).first().q
    assert np.allclose(got, np.quantile(own, points), rtol=1e-12)
    # the cells that are looked into one by one hold few values, though all but one lie in 1e-9 of the range
    known = S.with_order_key(df.select("k", F.col("x").alias("_x")), "_x", "_k")
    exponent = known.groupBy("k", F.shiftright("_k", 52).alias("_cell")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n")).limit(1).withColumns({"_i": F.lit(0), "_rank": F.lit(1000).cast("long")})
    finer = S._descend(known.withColumn("_cell", F.shiftright("_k", 52)), exponent, ["k"], 39).first()
    assert exponent.first()._n > 400_000 and finer._n < 500


@pytest.mark.parametrize("direct", [0, 3, 1 << 16])
def test_groups_equal_numpy(spark, direct):
    rng = random.Random(4)
    make = [lambda: rng.random(), lambda: rng.choice([-1.5, 0.0, -0.0, 2.5]), lambda: rng.lognormvariate(0, 40) * rng.choice([-1, 1]), lambda: 7.0, lambda: rng.choice([5e-324, -5e-324, 1e308, -1e308])]
    rows = [(k if k else None, f()) for k, f in enumerate(make) for _ in range(rng.randint(200, 400))] + [(8, 3.25), (9, None), (1, None), (1, float("nan")), (1, float("inf"))]
    df = spark.createDataFrame(rows, "k int, x double").repartition(3)
    points = [0.0, 0.02, 1 / 3, 0.98, 1.0]
    got = {r.k: r.q for r in S.exact_percentiles(df, ["k"], "x", points, direct).collect()}
    want = {k: np.array([x for q, x in rows if q == k and x is not None and np.isfinite(x)]) for k in (None, 1, 2, 3, 4, 8)}
    assert set(got) == set(want)
    for k, x in want.items():
        s, at = np.sort(x), [p * (len(x) - 1) for p in points]
        assert np.allclose(got[k], [s[int(a)] * (1 - a % 1) + s[int(np.ceil(a))] * (a % 1) for a in at], rtol=1e-9), k
    whole = S.exact_percentiles(df, [], "x", [0.5], direct).first().q[0]
    assert whole == pytest.approx(float(np.median([x for _, x in rows if x is not None and np.isfinite(x)])))
    assert S.exact_percentiles(df.where("k = 9"), ["k"], "x", points, direct).count() == 0
