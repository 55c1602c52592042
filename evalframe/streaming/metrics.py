"""Incremental forms of the evaluation and training operators for Structured Streaming.

Each takes a streaming DataFrame and returns one, for the caller's sink. Their
results over all input equal those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_confusion(rows: DataFrame, keys: list[str], ignore: int | None = None) -> DataFrame:
    """Running confusion counts, for output mode ``complete`` or ``update``."""
    from evalframe.operators.confusion import confusion

    return confusion(rows, keys, ignore=ignore)


def _merged(batches: Iterator[pd.DataFrame], state: GroupState) -> tuple[np.ndarray, np.ndarray]:
    """All epochs of a run so far with their values, by epoch; the value that came first stands.

    A run has as many epochs as it was trained for, some hundreds, so its log fits its state, and a late epoch
    takes its place as if it had come in time.
    """
    new = pd.concat(list(batches)).dropna(subset=["epoch"])
    old = state.get if state.exists else ([], [])
    rows = pd.DataFrame({"epoch": [*old[0], *new["epoch"]], "value": [*old[1], *new["value"]]}, columns=["epoch", "value"])
    rows = rows.drop_duplicates("epoch").sort_values("epoch")
    epoch, value = rows["epoch"].to_numpy("int64"), rows["value"].to_numpy("float64")
    state.update((epoch.tolist(), value.tolist()))
    return epoch, value


_STATE = "epochs array<long>, values array<double>"


def _stopping(patience: int, min_delta: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epochs, values = _merged(batches, state)
        best, wait, stop = float("inf"), 0, -1
        for epoch, value in zip(epochs.tolist(), values.tolist()):
            if value < best - min_delta:
                best, wait = value, 0
            else:
                wait += 1
                if wait >= patience:
                    stop = epoch
                    break
        last = int(epochs[-1]) if len(epochs) else -1
        yield pd.DataFrame({"run_id": [key[0]], "best": [best], "wait": [wait], "stop_epoch": [stop], "last_epoch": [last], "epochs": [len(epochs)]})

    return run


def stream_early_stopping(log: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """Best value, wait and stop epoch (-1: going on) of each run after each micro-batch. ``log``: run_id, epoch, value.

    Epochs may come in any order; the row of a run with the most ``epochs`` is its latest.
    """
    schema = "run_id long, best double, wait int, stop_epoch int, last_epoch int, epochs int"
    return log.groupBy("run_id").applyInPandasWithState(_stopping(patience, min_delta), schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def _improving(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = _improvements(*(np.array(x) for x in state.get)) if state.exists else {}
    epochs, values = _merged(batches, state)
    now = _improvements(epochs, values)
    rows = [(key[0], e, v, True, len(epochs)) for e, v in now.items() if e not in before]
    rows += [(key[0], e, v, False, len(epochs)) for e, v in before.items() if e not in now]
    yield pd.DataFrame(rows, columns=["run_id", "epoch", "value", "improved", "epochs"]).astype({"run_id": "int64", "epoch": "int32", "value": "float64", "improved": bool, "epochs": "int32"})


def _improvements(epochs: np.ndarray, values: np.ndarray) -> dict[int, float]:
    """Epochs whose value is under all earlier ones."""
    before = np.fmin.accumulate(np.append(np.inf, values))[:-1]  # an undefined value improves nothing
    return {int(e): float(v) for e, v, b in zip(epochs, values, before) if v < b}


def stream_best_checkpoints(log: DataFrame) -> DataFrame:
    """A row whenever a run's value strictly improves, and one with ``improved`` false for each that a late epoch undoes.

    Of the rows of a run and epoch that with the most ``epochs`` holds; see ``standing_checkpoints``.
    """
    return log.groupBy("run_id").applyInPandasWithState(_improving, "run_id long, epoch int, value double, improved boolean, epochs int", _STATE, "append", GroupStateTimeout.NoTimeout)


def standing_checkpoints(rows: DataFrame) -> DataFrame:
    """(run_id, epoch, value) of what ``stream_best_checkpoints`` has put out and not taken back."""
    last = rows.groupBy("run_id", "epoch").agg(F.max_by(F.struct("value", "improved"), "epochs").alias("r"))
    return last.where("r.improved").select("run_id", "epoch", F.col("r.value").alias("value"))


def latest_stops(rows: DataFrame) -> DataFrame:
    """The latest row of each run that ``stream_early_stopping`` has put out."""
    last = rows.groupBy("run_id").agg(F.max_by(F.struct("best", "wait", "stop_epoch", "last_epoch"), "epochs").alias("r"))
    return last.select("run_id", "r.*")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that there is into Parquet files under a shared path, and reads them.

    ``complete`` results replace each other by micro-batch; the last stays.
    """
    spark: SparkSession = stream.sparkSession
    out = f"{path}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
