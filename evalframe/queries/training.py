"""Queries on metric logs, losses and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.exprs import r6
from evalframe.operators import training_log as L
from evalframe.queries.fixtures import query
from evalframe.sources.shared import scratch
from evalframe.streaming import metrics as ST
from evalframe.streaming import stateful as SF


@query("w08_best_so_far", "SELECT run_id, epoch, best_before, coalesce(value < best_before, true) AS improved FROM (SELECT *, min(value) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM metric_log)")
def _(t):
    return L.best_so_far(t.metric_log).select("run_id", "epoch", "best_before", "improved")


PATIENCE, DELTA = 4, 1.0
STOPS = f"""WITH RECURSIVE fold AS (SELECT run_id, epoch, value AS best, 0 AS wait, CAST(NULL AS INT) AS stop FROM metric_log WHERE epoch = 0 UNION ALL
 SELECT m.run_id, m.epoch, CASE WHEN f.stop IS NULL AND m.value < f.best - {DELTA} THEN m.value ELSE f.best END, CASE WHEN f.stop IS NOT NULL THEN f.wait WHEN m.value < f.best - {DELTA} THEN 0 ELSE f.wait + 1 END,
 CASE WHEN f.stop IS NOT NULL THEN f.stop WHEN m.value >= f.best - {DELTA} AND f.wait + 1 >= {PATIENCE} THEN m.epoch END FROM fold f JOIN metric_log m ON m.run_id = f.run_id AND m.epoch = f.epoch + 1)
 SELECT run_id, best, stop AS stop_epoch, wait FROM fold f WHERE epoch = (SELECT max(epoch) FROM metric_log m WHERE m.run_id = f.run_id)"""


@query("w09_early_stopping", STOPS)
def _(t):
    return L.early_stopping(t.metric_log, PATIENCE, DELTA)


@query("w10_running_mean_loss", "SELECT run_id, epoch, round(1e-9 + avg(value) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean FROM metric_log")
def _(t):
    return L.running_mean(t.metric_log, ["run_id"], ["epoch"]).select("run_id", "epoch", r6(F.col("running_mean") + 1e-9).alias("running_mean"))


LSE = "list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))))"
L10 = "SELECT vec_id, label, list_transform(logits, lambda x: CAST(x AS DOUBLE)) AS l FROM logits"
CE = f"SELECT round(avg(z - l[label + 1]), 6) AS cross_entropy FROM (SELECT *, {LSE} AS z FROM ({L10}))"
DICE = f"""SELECT round(1 - avg(d), 6) AS soft_dice FROM (SELECT c, (2 * sum(CASE WHEN label = c THEN p ELSE 0 END) + 1) / (sum(p) + sum(CASE WHEN label = c THEN 1 ELSE 0 END) + 1) AS d
 FROM (SELECT label, unnest(range(10)) AS c, unnest(list_transform(l, lambda x: exp(x - z))) AS p FROM (SELECT *, {LSE} AS z FROM ({L10}))) GROUP BY c)"""


@query("g34_cross_entropy", CE)
def _(t):
    return L.cross_entropy(t.logits).select(r6(F.col("cross_entropy")).alias("cross_entropy"))


@query("g35_soft_dice", DICE)
def _(t):
    return L.soft_dice(t.logits).select(r6(F.col("soft_dice")).alias("soft_dice"))


@query("g36_dice_ce", f"SELECT round(0.5 * c + 0.5 * d, 5) AS dice_ce FROM (SELECT cross_entropy AS c FROM ({CE})), (SELECT soft_dice AS d FROM ({DICE}))")
def _(t):
    out = L.dice_ce(t.logits)
    return out.select(F.round(0.5 * r6(F.col("cross_entropy")) + 0.5 * r6(F.col("soft_dice")), 5).alias("dice_ce"))


@query("g37_run_summary", "SELECT run_id, count(*) AS epochs, min(value) AS best_value, arg_min(epoch, struct_pack(v := value, e := epoch)) AS best_epoch, arg_max(value, epoch) AS last_value FROM metric_log GROUP BY ALL")
def _(t):
    return L.run_summary(t.metric_log)


def table_stream(t, name: str):
    """A given table, one file or a folder of them, as a stream (a glob may name either)."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.dir}/{name}.parque[t]")


def log_stream(t):
    """The metric log as a stream of events; epochs are numbered before, since streams have no row numbers."""
    return table_stream(t, "events")


@query("st01_stream_confusion", "SELECT l_returnflag AS model_id, CAST(l_partkey % 4 AS INT) AS true_class, CAST((l_partkey + l_suppkey) % 4 AS INT) AS pred_class, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    rows = table_stream(t, "lineitem")
    rows = rows.select(F.col("l_returnflag").alias("model_id"), (F.col("l_partkey") % 4).cast("int").alias("true_class"), ((F.col("l_partkey") + F.col("l_suppkey")) % 4).cast("int").alias("pred_class"))
    return ST.drain(ST.stream_confusion(rows, ["model_id"]), scratch(t.spark, "st01"), "complete")


@query("st02_stream_metric_log", "SELECT event_id, user_id AS run_id, value FROM events")
def _(t):
    rows = log_stream(t).select("event_id", F.col("user_id").alias("run_id"), "value")
    return ST.drain(rows, scratch(t.spark, "st02"))


def stored_log(t, name: str):
    """The numbered log as files, and a stream over them."""
    path = scratch(t.spark, name)
    log = t.metric_log.select(F.col("run_id").cast("long").alias("run_id"), "epoch", F.col("value").cast("double").alias("value"))
    log.write.parquet(f"{path}/log")
    return t.spark.readStream.schema(log.schema).parquet(f"{path}/log"), path


@query("st03_stream_early_stop", STOPS.replace("SELECT run_id, best, stop AS stop_epoch, wait FROM", "SELECT run_id, best, coalesce(stop, -1) AS stop_epoch FROM"))
def _(t):
    log, path = stored_log(t, "st03")
    out = ST.drain(ST.stream_early_stopping(log, PATIENCE, DELTA), path)
    return ST.latest_stops(out).select("run_id", "best", "stop_epoch")


@query("st04_stream_best_checkpoint", "SELECT run_id, epoch, value FROM (SELECT *, min(value) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM metric_log) WHERE value < b OR b IS NULL")
def _(t):
    log, path = stored_log(t, "st04")
    return ST.standing_checkpoints(ST.drain(ST.stream_best_checkpoints(log), path))


#: A run is five days of one user: it ends when nothing has come for as long; records may be a day late. Runs share calls by shard.
IDLE_DAYS, DELAY_DAYS = 5, 1
RUN_SHARDS = 2048
_DAY = 86_400_000


@query("st05_stream_run_ends", f"""{STOPS.replace('metric_log', 'run_log').replace("SELECT run_id, best, stop AS stop_epoch, wait FROM", "SELECT run_id, best, wait, coalesce(stop, -1) AS stop_epoch, epoch + 1 AS epochs, ended AS final FROM").replace("FROM fold f WHERE epoch", f"FROM fold f JOIN (SELECT run_id AS r, max(epoch_ms(ts)) + {IDLE_DAYS * _DAY} <= (SELECT max(epoch_ms(ts)) - {DELAY_DAYS * _DAY} FROM events) AS ended FROM run_log GROUP BY run_id) ON r = f.run_id WHERE epoch")}""")
def _(t):
    path = scratch(t.spark, "st05")
    t.run_log.write.parquet(f"{path}/log")
    log = t.spark.readStream.schema(t.run_log.schema).parquet(f"{path}/log")
    with SF.state_store(t.spark):
        out = SF.drain_updates(SF.stream_stops(log, PATIENCE, DELTA, f"{DELAY_DAYS} day", IDLE_DAYS * _DAY, RUN_SHARDS), path)
    return SF.last_states(out)


@query("st06_stream_windows", f"""SELECT CAST(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS VARCHAR) AS start, user_id % 5 AS team, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events
 GROUP BY time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), user_id % 5 HAVING epoch_ms(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) + {_DAY // 4} <= (SELECT max(epoch_ms(ts)) - {_DAY} FROM events)""")
def _(t):
    rows = log_stream(t).withColumn("team", F.col("user_id") % 5)
    out = ST.drain(SF.stream_windows(rows, ["team"], "6 hours", "1 day", "value"), scratch(t.spark, "st06"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "team", "n", F.round("total", 4).alias("total"), "least", "most")
