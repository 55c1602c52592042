"""Stateful streams whose state ends: runs that stop or fall silent, and windows that the watermark closes.

Needs the RocksDB state store and, in Python, the ``protobuf`` package that Spark's
state server speaks; ``state_store`` sets the former.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNS = "run_id long, best double, wait int, stop_epoch int, epochs int, final boolean"
_FOLD = {"run_id": "long", "best": "double", "wait": "int", "stop": "int", "next": "int", "epochs": "int", "until": "long", "early": "int"}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which named states and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class EarlyStopping(StatefulProcessor):
    """Folds each run's epochs in their order, whatever order they come in.

    State of a run: the fold so far, and only those epochs that came before one that is still missing. A run ends when
    no record has come for ``idle`` milliseconds of event time: its row is put out as final, with epochs behind a gap
    folded as they are, and its state is cleared. A call costs milliseconds, and so does what is asked of the state, thus
    a key may stand for many runs: their folds are one list, and one timer waits for the first of them to end.
    """

    def __init__(self, patience: int, min_delta: float, idle: int):
        self.patience, self.min_delta, self.idle = patience, min_delta, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folds = handle.getListState("fold", ", ".join(f"{c} {kind}" for c, kind in _FOLD.items()))
        self.early = handle.getMapState("early", "run_id long, epoch int", "value double")

    def _step(self, fold: dict, epoch: int, value: float | None) -> None:
        if fold["stop"] < 0:
            if value is not None and value < fold["best"] - self.min_delta:
                fold["best"], fold["wait"] = value, 0
            else:
                fold["wait"] += 1
                fold["stop"] = epoch if fold["wait"] >= self.patience else -1
        fold["next"], fold["epochs"] = epoch + 1, fold["epochs"] + 1

    def _add(self, fold: dict, epoch: int, value: float | None) -> None:
        """``early`` counts the run's early epochs, so that the state is asked for them only where there are any."""
        run = fold["run_id"]
        if epoch > fold["next"] and not (fold["early"] and self.early.containsKey((run, epoch))):
            self.early.updateValue((run, epoch), (value,))
            fold["early"] += 1
        elif epoch == fold["next"]:
            self._step(fold, epoch, value)
            while fold["early"] and self.early.containsKey(at := (run, fold["next"])):
                self._step(fold, at[1], self.early.getValue(at)[0])
                self.early.removeKey(at)
                fold["early"] -= 1

    def _stored(self) -> dict[int, dict]:
        return {f[0]: dict(zip(_FOLD, f)) for f in self.folds.get()}

    def _store(self, folds: list[dict], timer: int | None) -> None:
        """Keeps the folds, and a timer for the first of them in place of the given one."""
        if not folds:
            self.folds.clear()
            return
        self.folds.put([tuple(f.values()) for f in folds])
        first = min(f["until"] for f in folds)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)

    def _rows(self, folds: list[dict], final: bool) -> pd.DataFrame:
        out = pd.DataFrame(folds, columns=list(_FOLD)).rename(columns={"stop": "stop_epoch"})
        return out[["run_id", "best", "wait", "stop_epoch", "epochs"]].astype({"wait": "int32", "stop_epoch": "int32", "epochs": "int32"}).assign(final=final)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        folds = self._stored()
        timer = min((f["until"] for f in folds.values()), default=None)
        new = pd.concat([r[r["known"]] for r in rows])
        if new.empty:
            return
        last = new.groupby("run_id")["at"].max()
        for run, at in zip(last.index.tolist(), last.tolist()):
            fold = folds.setdefault(run, dict(zip(_FOLD, (run, float("inf"), 0, -1, 0, 0, at + self.idle, 0))))
            fold["until"] = max(fold["until"], at + self.idle)
        new = new.dropna(subset=["epoch"]).drop_duplicates(["run_id", "epoch"]).sort_values(["run_id", "epoch"])
        for run, epoch, value in zip(new["run_id"].tolist(), new["epoch"].astype(int).tolist(), new["value"].astype(float).tolist()):
            self._add(folds[run], epoch, None if value != value else value)
        self._store(list(folds.values()), timer)
        yield self._rows([folds[run] for run in last.index.tolist()], False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        folds, now = self._stored(), timerValues.getCurrentWatermarkInMs()
        ended = {run: f for run, f in folds.items() if f["until"] <= now}  # as timers expire
        left = [f for run, f in folds.items() if run not in ended]
        if any(f["early"] for f in ended.values()):
            gone = sorted((*k, v[0]) for k, v in self.early.iterator() if k[0] in ended)
            for run, epoch, value in gone:
                self._step(ended[run], epoch, value)
                self.early.removeKey((run, epoch))
        self._store(left, None)
        yield self._rows(list(ended.values()), True)


def stream_stops(log: DataFrame, patience: int, min_delta: float = 0.0, delay: str = "1 hour", idle_ms: int = 3_600_000, shards: int | None = None) -> DataFrame:
    """(run_id, best, wait, stop_epoch, epochs, final): each run's state after each micro-batch, and once more when it ends.

    ``log``: run_id, epoch (from 0), value, ts (a timestamp; records without a time or a run go). Records up to ``delay`` late count as if in time; later ones
    may be dropped. Of a repeated epoch the first value that comes stands; an undefined value improves nothing. Records
    without an epoch only keep their run alive. With ``shards`` that many keys hold the runs by hash, else each run is its own: fewer calls where
    runs are many, but a micro-batch reads and writes the folds of all open runs of a shard, and holds its records in memory.
    """
    ts = F.col("ts").cast("timestamp")
    timed = log.where("ts is not null").select(F.coalesce("run_id", F.lit(0)).alias("run_id"), F.col("run_id").isNotNull().alias("known"), "epoch", "value", ts.alias("ts"), F.unix_millis(ts).alias("at")).withWatermark("ts", delay)
    keyed = timed.groupBy("run_id") if shards is None else timed.withColumn("shard", F.pmod(F.hash("run_id"), F.lit(shards))).groupBy("shard")
    return keyed.transformWithStateInPandas(EarlyStopping(patience, min_delta, idle_ms), RUNS, "Update", "EventTime")


def last_states(rows: DataFrame) -> DataFrame:
    """The row of each run that holds: the final one, else that with the most epochs."""
    return rows.groupBy("run_id").agg(F.max_by(F.struct("best", "wait", "stop_epoch", "epochs", "final"), F.struct("final", "epochs")).alias("r")).select("run_id", "r.*")


def stream_windows(rows: DataFrame, keys: list[str], width: str, delay: str, value: str) -> DataFrame:
    """(start, *keys, n, total, least, most) of each closed window of event time, once; its state goes with it. ``rows`` have ``ts``."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = timed.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total", "least", "most")


def drain_updates(stream: DataFrame, path: str, trigger: dict | None = None) -> DataFrame:
    """Runs a stream in update mode over all that there is; every micro-batch adds its rows under a shared path, once."""
    spark = stream.sparkSession

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)
