"""Filling containers of fixed capacity with items of varying size, by vector best fit.

Each container has three capacities: tokens, number of documents, and attention cost (the sum of squared lengths). An
item goes into the open container that takes it under every capacity and is best by the rule: the smallest weighted
norm of what stays free ("norm"), or the largest weighted dot product of item and free capacity ("dot"). Items come by
decreasing size. A document is divided only if it alone exceeds the capacity.

Packing runs inside the partitions of the scan, in blocks of bounded size, without a shuffle; the few containers that a
block leaves half empty are opened and their items packed again together, over all partitions, in as many tasks as their
number asks for.

Defined results: null and empty texts are items of size 0 that take a document's place only; repeats of a document are
items of their own; an empty table gives no container. No item is dropped, none exceeds a capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.encoding import token_counts
from corvane.storage import written

CAPACITY, MAX_DOCUMENTS = 2048, 1024
#: Items packed together at once: bounds a task's memory and keeps the search for the best container short.
BLOCK = 16_384


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> np.ndarray:
    """The container number of each item. Sizes must not exceed the capacity."""
    attention = float(capacity) ** 2 if attention is None else attention
    full = np.array([capacity, max_documents, attention], float)
    w = np.asarray(weights, float)
    n = len(sizes)
    free = np.empty((3, max(n, 1)))  # of each open container, as shares of the capacities
    names = np.empty(max(n, 1), np.int64)
    used = count = 0
    out = np.empty(n, np.int64)
    slack = 1e-12
    order = np.argsort(-sizes, kind="stable")
    if n and (sizes[order[0]] > capacity or sizes[order[0]] ** 2 > attention):
        raise ValueError("an item exceeds the capacity")
    for i in order:
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2]) / full
        at = -1
        if used:
            left = free[:, :used] - need[:, None]
            fits = (left >= -slack).all(axis=0)
            if fits.any():
                score = -(w[:, None] * left * left).sum(axis=0) if rule == "norm" else (w[:, None] * free[:, :used] * need[:, None]).sum(axis=0)
                score[~fits] = -np.inf
                at = int(np.argmax(score))
        if at < 0:
            at, used, count = used, used + 1, count + 1
            names[at] = count - 1
            free[:, at] = 1.0
        free[:, at] -= need
        out[i] = names[at]
        if free[1, at] < 1 / max_documents - slack or (free[0, at] <= slack and sizes[i]):
            # A container without room is closed: it makes way for the last open one.
            used -= 1
            free[:, at], names[at] = free[:, used], names[used]
    return out


def _pack(rows: DataFrame, round_no: int, limits: dict) -> DataFrame:
    """Adds container_id; blocks within partitions."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", container_id bigint, free bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = (round_no << 58) | (TaskContext.get().partitionId() << 34)
        done = 0
        held: list[pd.DataFrame] = []

        def packed() -> pd.DataFrame:
            nonlocal done, held
            df = pd.concat(held, ignore_index=True)
            held = []
            sizes = df["n_tokens"].to_numpy(np.int64)
            own = best_fit(sizes, **limits)
            left = limits["capacity"] - np.bincount(own, weights=sizes).astype(np.int64)
            df["container_id"], df["free"] = base + done + own, left[own]
            done += len(left)
            return df

        n = 0
        for df in batches:
            for i in range(0, len(df), BLOCK):
                held.append(df.iloc[i : i + BLOCK])
                n += len(held[-1])
                if n >= BLOCK:
                    yield packed()
                    n = 0
        if held and n:
            yield packed()

    return rows.mapInPandas(run, schema)


def pack(sizes: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", slack: float = 0.01) -> DataFrame:
    """(doc_id, piece_no, start, n_tokens, container_id) from (doc_id, n_tokens).

    A container with more than `slack` of its capacity free after the first round is opened for the second.
    """
    limits = dict(capacity=capacity, max_documents=max_documents, attention=attention, weights=weights, rule=rule)
    n = F.coalesce("n_tokens", F.lit(0))
    pieces = sizes.select("doc_id", F.greatest(n, F.lit(0)).alias("n")).select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1)))).select(
        "doc_id", (F.col("pos") + 1).alias("piece_no"), (F.col("pos") * F.lit(capacity).cast("bigint")).alias("start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("pos") * capacity).cast("bigint").alias("n_tokens"),
    )
    first = written(_pack(pieces, 0, limits), "packed")
    open_ = F.col("free") > int(capacity * slack)
    names = ["doc_id", "piece_no", "start", "n_tokens", "container_id"]
    again = first.filter(open_).drop("container_id", "free")
    tasks = -(-again.count() // BLOCK)
    if tasks:
        again = _pack(again.repartition(tasks, "doc_id", "piece_no"), 1, limits)
        return first.filter(~open_).select(*names).unionByName(again.select(*names))
    return first.select(*names)


def pack_documents(documents: DataFrame, path: str | None = None, **limits) -> DataFrame:
    """Containers for documents sized in tokens of the public vocabulary."""
    return pack(token_counts(documents, path=path), **limits)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, containers, the least possible number of containers, and the share of space used."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return per.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_containers"),
        F.ceil(F.coalesce(F.sum("tokens"), F.lit(0)) / capacity).alias("least_containers"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"),
    ).withColumn("used", F.when(F.col("n_containers") > 0, F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6)))
