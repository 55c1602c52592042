"""Streams whose state ends against batch results."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalframe import queries
from evalframe.operators import training_log as L
from evalframe.queries import training
from evalframe.streaming import metrics as ST
from evalframe.streaming import stateful as SF
from tests.oracle import assert_same, connection

START = datetime(2024, 1, 1)
LOG = "run_id long, epoch int, value double, ts timestamp"


@pytest.fixture
def rocks(spark):
    with SF.state_store(spark):
        yield spark


def stream_of(spark, batches, path):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
        for p in Path(f"{path}/log").glob("part-*"):
            if not p.name.startswith("part-9"):
                p.rename(p.with_name(f"part-9{i:03}.parquet"))
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")


def test_stops_equal_batch_and_state_ends(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(r, e, float(rng.randint(0, 50)), START + timedelta(minutes=e)) for r in range(6) for e in range(15)]
    late = rows[:]
    rng.shuffle(late)  # in no order, but all within the watermark's delay
    others = [(99, 0, 1.0, START + timedelta(days=1)), (99, 1, 2.0, START + timedelta(days=1, minutes=1))]
    batches = [late[0::3], late[1::3], late[2::3], others[:1], [*others[1:], (3, 7, -5.0, START)]]  # the last record is too late
    stream = SF.stream_stops(stream_of(rocks, batches, str(tmp_path)), 3, 1.0, "2 hours", 3_600_000)
    out = SF.drain_updates(stream, str(tmp_path))
    got = {r.run_id: r for r in SF.last_states(out).collect()}
    log = rocks.createDataFrame(rows + others, LOG).select("run_id", "epoch", "value")
    want = {r.run_id: r for r in L.early_stopping(log, 3, 1.0).collect()}
    for run, r in want.items():
        assert (got[run].best, got[run].stop_epoch, got[run].epochs) == (r.best, -1 if r.stop_epoch is None else r.stop_epoch, 2 if run == 99 else 15)
        assert got[run].final == (run != 99)
    assert out.where("final").count() == 6
    fold = rocks.read.format("statestore").option("stateVarName", "fold").load(f"{tmp_path}/state")
    assert [r[0] for r in fold.select("key.run_id").collect()] == [99]
    early = rocks.read.format("statestore").option("stateVarName", "early").load(f"{tmp_path}/state")
    assert early.count() == 0


def test_a_gap_is_folded_when_the_run_ends(rocks, tmp_path):
    rows = [(1, e, 10.0 - e, START + timedelta(minutes=e)) for e in (0, 1, 3, 4)] + [(1, 1, 0.0, START), (1, None, 1.0, START)]
    end = [(2, 0, None, START + timedelta(days=2))]
    stream = SF.stream_stops(stream_of(rocks, [rows, end, [(2, 1, 4.0, START + timedelta(days=2))]], str(tmp_path)), 5, 0.0, "1 minute", 60_000)
    out = SF.drain_updates(stream, str(tmp_path))
    got = [(r.run_id, r.best, r.epochs, r.final) for r in out.orderBy("run_id", "final", "epochs").collect()]
    assert got == [(1, 9.0, 2, False), (1, 6.0, 4, True), (2, float("inf"), 1, False), (2, 4.0, 2, False)]


def test_windows_close_once(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randint(0, 2), None, float(rng.randint(0, 9)), START + timedelta(minutes=m + rng.randint(-20, 20))) for m in range(0, 600, 2)]
    batches = [rows[:100], rows[100:200], rows[200:]]
    stream = SF.stream_windows(stream_of(spark, batches, str(tmp_path)), ["run_id"], "1 hour", "1 hour", "value")
    got = sorted(tuple(r) for r in ST.drain(stream, str(tmp_path)).collect())
    batch = spark.createDataFrame(rows, LOG).groupBy(F.window("ts", "1 hour"), "run_id").agg(F.count("*"), F.sum("value"), F.min("value"), F.max("value"))
    closed = max(r[3] for r in rows) - timedelta(hours=1)
    want = sorted((r[0].start, *r[1:]) for r in batch.collect() if r[0].end <= closed)
    assert got == want and len(got) > 15


def test_runs_of_a_shard_end_as_they_do_alone(rocks, tmp_path):
    rng = random.Random(7)
    rows = [(r, e, rng.choice([None, float(rng.randint(0, 30))]), START + timedelta(minutes=e, seconds=r // 2)) for r in range(40) for e in range(12) if (r * 5 + e) % 17]  # with gaps
    rows += [(r, e, 0.0, START + timedelta(minutes=e)) for r in range(0, 40, 3) for e in (4, 4)] + [(50, None, 1.0, START), (None, 0, 1.0, START)]
    rng.shuffle(rows)
    # by the watermark some runs are to end just then, some a second before or after it
    waves = [[(60, 0, 1.0, START + timedelta(minutes=11 + 30 + 60, seconds=s))] for s in (0, 7, 8, 19)]
    batches = [rows[0::3], rows[1::3], rows[2::3], *waves, [(61, 0, 2.0, START + timedelta(hours=5))], [(61, 1, 3.0, START + timedelta(hours=5))]]
    got = {}
    for shards in (None, 3):
        path = str(tmp_path / f"{shards}")
        out = SF.drain_updates(SF.stream_stops(stream_of(rocks, batches, path), 3, 1.0, "30 minutes", 3_600_000, **({"shards": shards} if shards else {})), path)
        got[shards] = sorted(map(repr, out.join(rocks.read.parquet(f"{path}/out").select("run_id", "final", "epochs", "batch").distinct(), ["run_id", "final", "epochs"]).collect()))
        fold = rocks.read.format("statestore").option("stateVarName", "fold").load(f"{path}/state")
        assert fold.count() == 1  # that of run 61
        assert rocks.read.format("statestore").option("stateVarName", "early").load(f"{path}/state").count() == 0
        assert {r.run_id for r in out.select("run_id").distinct().collect()} == {*range(40), 50, 60, 61}
    assert got[3] == got[None] and sum("final=True" in r for r in got[3]) >= 42


def test_the_runs_of_the_query_share_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "scratch", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(training, "RUN_SHARDS", 4, raising=False)
    assert_same(spark, connection(), queries.all_queries()["st05_stream_run_ends"], queries.all_sql()["st05_stream_run_ends"])
    fold = spark.read.format("statestore").option("stateVarName", "fold").load(str(tmp_path / "st05/state"))
    assert fold.count() == 26 and fold.select("key").distinct().count() <= 4  # 26 keys for as many open runs, and a call for each, before
