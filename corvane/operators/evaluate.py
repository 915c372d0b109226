"""Retrieval and answer metrics over ranked results.

Ranked results are (query_id, id, rank), gold is (query_id, id); every query of `queries` (query_id) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(queries: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank, is_gold, n_gold): hits marked by gold; queries without hits keep one row without rank."""
    marked = ranked.join(gold.select("query_id", "id", F.lit(True).alias("g")).distinct(), ["query_id", "id"], "left")
    n = gold.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return queries.select("query_id").distinct().join(marked.select("query_id", "rank", F.coalesce("g", F.lit(False)).alias("is_gold")), "query_id", "left").join(n, "query_id", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))


def _found(k: int) -> Column:
    return F.count_if(F.coalesce(F.col("is_gold"), F.lit(False)) & (F.col("rank") <= k))


def metrics(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, hit, reciprocal_rank) at k. Recall of a query without gold is 0, precision divides by k."""
    first = F.min(F.when(F.col("is_gold"), F.col("rank")))
    n = F.max("n_gold")
    return rows.groupBy("query_id").agg(
        F.round(F.when(n > 0, _found(k) / n).otherwise(F.lit(0.0)), 6).alias("recall"),
        F.round(_found(k) / k if k > 0 else F.lit(0.0), 6).alias("precision"),
        (_found(k) > 0).alias("hit"),
        F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def latency_summary(values: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, mean, median, p95, low, high, per_second): p95 is the nearest rank. Null values don't count.

    The nearest rank is found by the exact `percentile_disc`, so no list of values is built.
    """
    v = F.col(value)
    return values.filter(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.5), 6).alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)").alias("p95"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.round(1000.0 / F.avg(v), 6).alias("per_second"),
    )


def retrieval_summary(rows: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5), kind: DataFrame | None = None) -> DataFrame:
    """One row (per gold type, if `kind` (query_id, gold_type) has more than one): recall at the cutoffs, hit at 1, mrr."""
    per = rows.groupBy("query_id").agg(
        *[F.when(F.max("n_gold") > 0, _found(k) / F.max("n_gold")).otherwise(F.lit(0.0)).alias(f"r{k}") for k in cutoffs],
        (_found(1) > 0).cast("double").alias("h1"), F.coalesce(1.0 / F.min(F.when(F.col("is_gold"), F.col("rank"))), F.lit(0.0)).alias("rr"),
    )
    by = []
    if kind is not None:
        per, by = per.join(kind.select("query_id", "gold_type").distinct(), "query_id", "left"), ["gold_type"]
    return per.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(f"r{k}"), 6).alias(f"recall_at_{k}") for k in cutoffs], F.round(F.avg("h1"), 6).alias("hit_at_1"), F.round(F.avg("rr"), 6).alias("mrr"))


def resolve_gold(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): chunks (id, text) that have any of a query's needles (query_id, needles), case and blanks aside.

    Every needle is held against every text, as written; each distinct needle is looked for once, whoever asks for it.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    asked = queries.select("query_id", F.explode("needles").alias("n")).select("query_id", flat(F.col("n")).alias("needle")).filter("needle <> ''").distinct()
    hay = chunks.select("id", flat(F.col("text")).alias("hay"))
    return hay.join(asked.select("needle").distinct(), F.contains("hay", "needle")).select("id", "needle").join(asked, "needle").select("query_id", "id").distinct()


def gold_triage(queries: DataFrame) -> DataFrame:
    """(query_id, state) of (query_id, n_gold, expected_missing): resolved, known_gap, rot or stale_flag."""
    some, flag = F.col("n_gold") > 0, F.coalesce("expected_missing", F.lit(False))
    return queries.select("query_id", F.when(some & flag, "stale_flag").when(some, "resolved").when(flag, "known_gap").otherwise("rot").alias("state"))


def judge_summary(rows: DataFrame, pass_at: int = 4, *by: str) -> DataFrame:
    """Answer quality of (context_sufficient, correctness, groundedness): means, share of passes, and the mean given enough context."""
    c = F.col("correctness")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(c), 6).alias("correctness"), F.round(F.avg("groundedness"), 6).alias("groundedness"),
        F.round(F.avg((c >= pass_at).cast("double")), 6).alias("pass_rate"), F.round(F.avg(F.when(F.col("context_sufficient"), c)), 6).alias("correctness_with_context"),
    )


def routing_summary(rows: DataFrame) -> DataFrame:
    """Per expected tier: n, accuracy, recall of the complex tier's fan-out. Rows (expected_tier, tier, n_nodes)."""
    right = (F.col("tier") == F.col("expected_tier")).cast("double")
    return rows.groupBy("expected_tier").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("n_nodes"), 6).alias("mean_nodes"), F.max("n_nodes").alias("most_nodes"))
