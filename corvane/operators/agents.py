"""Tasks, plans and runs: the state that event logs imply."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.groups import fold_groups
from corvane.storage import written

RECLAIM_IDLE_MS, MAX_ATTEMPTS = 5000, 3


def task_state(events: DataFrame) -> DataFrame:
    """(task_id, state, attempts, last_ts) of events (task_id, ts, event: enqueued | claimed | acked | failed).

    By partial aggregation; a task is dead once it was claimed more than MAX_ATTEMPTS times without being acked.
    """
    s = events.groupBy("task_id").agg(F.count_if(F.col("event") == "claimed").alias("attempts"), F.count_if(F.col("event") == "acked").alias("acks"), F.max("ts").alias("last_ts"))
    state = F.when(F.col("acks") > 0, "done").when(F.col("attempts") > MAX_ATTEMPTS, "dead").when(F.col("attempts") > 0, "inflight").otherwise("pending")
    return s.select("task_id", state.alias("state"), "attempts", "last_ts")


def reclaimable(state: DataFrame, now: Column, idle: str = "5 seconds") -> DataFrame:
    """In-flight tasks that have been idle; tasks never delivered are not."""
    return state.filter((F.col("state") == "inflight") & (F.col("last_ts") <= now - F.expr(f"INTERVAL {idle}")))


def reclaim(state: DataFrame, now: Column, consumer: str, idle: str = "5 seconds") -> DataFrame:
    """(task_id, consumer, attempts): idle tasks handed over to `consumer`; handing over counts as a delivery."""
    return reclaimable(state, now, idle).select("task_id", F.lit(consumer).alias("consumer"), (F.col("attempts") + 1).alias("attempts"))


def queue_stats(state: DataFrame) -> DataFrame:
    return state.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "inflight", "dead", "done")])


def memo_skip(tasks: DataFrame, results: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks that have no result yet."""
    return tasks.join(results.select(key).distinct(), key, "left_anti")


def idempotency_key(run: Column, node: Column, capability: Column, inputs: Column) -> Column:
    """The first 16 hex digits of the digest of the sorted JSON of a task."""
    j = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.concat(F.lit('{"capability": '), j(capability), F.lit(', "inputs": '), inputs, F.lit(', "node_id": '), j(node), F.lit(', "run_id": '), j(run), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)


def ttl_sessions(writes: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, started, expires, n): every write renews a namespace as a whole, so its lives are session windows."""
    return writes.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n")


def schedule_due(ticks: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """(key, ts) of the ticks that run: the first, and every one at least the interval after the last run.

    Whether a tick runs depends on the run before, so a key's ticks are read in order as a stream; only the time of the
    last run is held. Null times never run.
    """
    kind = ticks.schema[key].dataType.simpleString()
    gap = minutes * 60_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), 0
        for df in batches:
            out = []
            for k, us in df.itertuples(index=False):
                if k != now or us >= last + gap:
                    now, last = k, us
                    out.append((k, us))
            if out:
                yield pd.DataFrame(out, columns=[key, "us"])

    rows = ticks.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).filter("us IS NOT NULL")
    runs = rows.repartition(key).sortWithinPartitions(key, "us").mapInPandas(fold, f"{key} {kind}, us bigint")
    return runs.select(key, F.timestamp_micros("us").alias(ts))


#: Plans up to this many nodes are peeled inside one task; larger ones wave by wave over all tasks.
SMALL_PLAN = 5000


def dag_waves(nodes: DataFrame) -> DataFrame:
    """(run_id, node_id, wave) of (run_id, node_id, depends_on): a node's wave is one after its last dependency's.

    Nodes on or behind a cycle, or with an unknown dependency, have no wave; no row either. A node named twice has the
    wave of all its dependencies together.
    """
    rows = nodes.select("run_id", "node_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    sizes = rows.groupBy("run_id").agg(F.count("*").alias("n_nodes"))
    large = sizes.filter(F.col("n_nodes") > SMALL_PLAN).select("run_id")
    small = rows.join(large, "run_id", "left_anti").select("run_id", "node_id", "depends_on")
    kind = nodes.schema["run_id"].dataType.simpleString()

    def peel(plan: list) -> list[tuple]:
        deps: dict[str, set] = {}
        for node in plan:
            deps.setdefault(node.node_id, set()).update(node.depends_on)
        waves: dict[str, int] = {}
        wave = 0
        while ready := [n for n, own in deps.items() if n not in waves and all(x in waves for x in own)]:
            waves.update(dict.fromkeys(ready, wave))
            wave += 1
        return [(plan[0].run_id, n, w) for n, w in waves.items()]

    out = fold_groups(small, "run_id", ["node_id"], peel, f"run_id {kind}, node_id string, wave int")
    return out if large.isEmpty() else out.unionByName(_waves_of_large(rows.join(large, "run_id", "left_semi").select("run_id", "node_id", "depends_on")))


def _waves_of_large(nodes: DataFrame) -> DataFrame:
    """Every round peels one wave of all runs at once; each wave is written, so a lost executor costs one wave."""
    edges = nodes.select("run_id", "node_id", F.explode_outer("depends_on").alias("dep")).distinct()
    done = edges.groupBy("run_id", "node_id").agg(F.count("dep").alias("n")).filter("n = 0").select("run_id", "node_id", F.lit(0).alias("wave"))
    done, wave = written(done, "waves"), 0
    while True:
        left = edges.join(done.select("run_id", "node_id"), ["run_id", "node_id"], "left_anti")
        met = left.join(done.select("run_id", F.col("node_id").alias("dep"), F.lit(1).alias("ok")), ["run_id", "dep"], "left")
        ready = met.groupBy("run_id", "node_id").agg(F.count_if(F.col("ok").isNull() & F.col("dep").isNotNull()).alias("open")).filter("open = 0")
        wave += 1
        fresh = written(ready.select("run_id", "node_id", F.lit(wave).alias("wave")), "waves")
        if fresh.isEmpty():
            return done
        done = done.unionByName(fresh)


def dag_valid(nodes: DataFrame) -> DataFrame:
    """(run_id, n_nodes, valid): no unknown dependency, no node twice, no cycle."""
    waves = dag_waves(nodes)
    n = nodes.groupBy("run_id").agg(F.count("*").alias("n_nodes"), F.countDistinct("node_id").alias("n_names"))
    m = waves.groupBy("run_id").agg(F.countDistinct("node_id").alias("n_waved"))
    return n.join(m, "run_id", "left").select("run_id", "n_nodes", ((F.col("n_names") == F.col("n_nodes")) & (F.coalesce("n_waved", F.lit(0)) == F.col("n_nodes"))).alias("valid"))


def planned(nodes: DataFrame, capability: str = "answer") -> DataFrame:
    """(run_id, node_id, depends_on) of the valid plans; a plan that isn't valid becomes one node that does it all."""
    valid = dag_valid(nodes)
    kept = nodes.select("run_id", "node_id", "depends_on").join(valid.filter("valid").select("run_id"), "run_id", "left_semi")
    alone = valid.filter("NOT valid").select("run_id", F.lit(capability).alias("node_id"), F.array().cast("array<string>").alias("depends_on"))
    return kept.unionByName(alone)


def plan_status(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, position, node_id, status): results in the order of the plan; a node without one failed."""
    return nodes.join(results.select("run_id", "node_id", F.lit("done").alias("status")).distinct(), ["run_id", "node_id"], "left").select("run_id", "position", "node_id", F.coalesce("status", F.lit("failed")).alias("status"))


def ledger(events: DataFrame) -> DataFrame:
    """(run_id, seq, ts, event): each run's events numbered in the order they were appended."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id"))).select("run_id", "seq", "ts", "event")


def owned(conversations: DataFrame, owner: str | None) -> DataFrame:
    """An owner's conversations; no owner stands for everyone's."""
    return conversations if owner is None else conversations.filter(F.col("owner_id") == owner)


def delete_conversation(conversations: DataFrame, messages: DataFrame, conversation_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a conversation and its messages."""
    keep = lambda df: df.filter(~F.col("conversation_id").eqNullSafe(F.lit(conversation_id)))
    return keep(conversations), keep(messages)


def append_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns (conversation_id, ...) put behind those of their conversation, in the order of their `created_at`."""
    last = messages.groupBy("conversation_id").agg(F.max("seq").alias("last"))
    order = F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at"))
    placed = turns.withColumn("n", order).join(last, "conversation_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("n")).drop("n", "last")
    return messages.unionByName(placed.select(*messages.columns))


def rename_conversation(conversations: DataFrame, conversation_id: str, title: str) -> DataFrame:
    return conversations.withColumn("title", F.when(F.col("conversation_id") == conversation_id, F.lit(title)).otherwise(F.col("title")))


def run_view(events: DataFrame, results: DataFrame, state: DataFrame) -> DataFrame:
    """(run_id, n_events, first_ts, last_ts, n_results, state): what is known of each run in the log."""
    log = events.groupBy("run_id").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    done = results.groupBy("run_id").agg(F.count("*").alias("n_results"))
    return log.join(done, "run_id", "left").join(state.select(F.col("task_id").alias("run_id"), "state"), "run_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
