"""Streams: task state, namespaces that expire, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.agents import MAX_ATTEMPTS


def task_states(events: DataFrame) -> DataFrame:
    """(task_id, state, attempts, acks): the state of each task after every batch of events (task_id, event).

    Only the counts of a task are kept; acked tasks stay known, so a late claim doesn't run them again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        attempts, acks = state.get if state.exists else (0, 0)
        for df in batches:
            attempts += int((df["event"] == "claimed").sum())
            acks += int((df["event"] == "acked").sum())
        state.update((attempts, acks))
        name = "done" if acks else "dead" if attempts > MAX_ATTEMPTS else "inflight" if attempts else "pending"
        yield pd.DataFrame({"task_id": [key[0]], "state": [name], "attempts": [attempts], "acks": [acks]})

    kind = events.schema["task_id"].dataType.simpleString()
    return events.groupBy("task_id").applyInPandasWithState(step, f"task_id {kind}, state string, attempts long, acks long", "attempts long, acks long", "update", GroupStateTimeout.NoTimeout)


def expiring_namespaces(writes: DataFrame, ts: str, key: str, ttl: str, late: str = "1 hour") -> DataFrame:
    """(key, started, expires, n): a namespace as a whole ends when it wasn't written for `ttl`; late writes still renew it."""
    w = writes.withWatermark(ts, late).groupBy(F.session_window(ts, ttl).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n")


def counts_by_window(events: DataFrame, ts: str, window: str, by: str, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("started"), by, "n")


def idempotent_sink(path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows whose key was written before are skipped; a batch that is run again writes its own folder again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            seen = spark.read.parquet(path).filter(F.col("batch_id") != batch_id).select(key)
            new = new.join(seen, key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(new).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
