"""Search over a chunk library: dense, lexical, fused and filtered, for a batch of queries against all rows.

Library tables have (id, text, embedding, publisher, source_type, category, published_date); query tables (query_id,
...). Results have (query_id, id, score, rank), ranked by score with ties by id.

Rows are packed into blocks, matrices for dense search and inverted lists for lexical search; a query block meets a row
block once, both of bounded size, and only the block's own top k leave it, so what is shuffled grows with the number of
blocks and not with the number of pairs.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import terms
from corvane.operators.groups import fold_groups

K1, B = 1.2, 0.75
RRF, POOL, WEIGHTS = 60, 50, (0.7, 0.3)
COSINE, BM25, NORMALIZED, RERANK = "cosine", "bm25", "normalized", "rerank"
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


def _positive(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def ranked(scores: DataFrame, k: int | None = None, by: str = "score") -> DataFrame:
    """The k best of each query, ties by id."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id")))
    return out if k is None else out.filter(F.col("rank") <= k)


# ---------------------------------------------------------------- vectors


def fake_embed(text: Column, dim: int = 8) -> Column:
    """A stand-in embedder: bytes of the text's digest as numbers from 0 to 1."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision, 0 if either is zero; unequal lengths fail."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double"))
    return F.coalesce(same, F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


def dense_topk(library: DataFrame, query: list[float], k: int) -> DataFrame:
    """One query: the planner turns order and limit into a distributed top k."""
    _positive(k)
    vector = F.array(*[F.lit(float(x)) for x in query])
    return library.select("id", F.round(cosine(F.col("embedding"), vector), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _blocks(rows: DataFrame, rows_per_block: int, name: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for i in range(0, len(df), rows_per_block):
                part = df.iloc[i : i + rows_per_block]
                m = np.stack([np.asarray(v, np.float32) for v in part["embedding"]])
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "vectors": [m.tobytes()], "width": [m.shape[1]]})

    return rows.filter("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding").mapInPandas(run, "ids binary, vectors binary, width int").select(*[F.col(c).alias(f"{name}_{c}") for c in ("ids", "vectors", "width")])


def dense_topk_batch(library: DataFrame, queries: DataFrame, k: int, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, embedding) against all rows (id, embedding), in blocks."""
    _positive(k)
    left = _blocks(library, row_block, "r")
    right = _blocks(queries.select(F.col("query_id").alias("id"), "embedding"), query_block, "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
        for df in batches:
            for r in df.itertuples(index=False):
                ids, qids = np.frombuffer(r.r_ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                m = unit(np.frombuffer(r.r_vectors, np.float32).reshape(len(ids), r.r_width).astype(float))
                q = unit(np.frombuffer(r.q_vectors, np.float32).reshape(len(qids), r.q_width).astype(float))
                order = np.argsort(ids, kind="stable")
                ids, m = ids[order], m[order]
                for a in range(0, len(qids), 128):
                    score = np.round(q[a : a + 128] @ m.T, 6) + 0.0
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ties by id, as the ids are in order
                    yield pd.DataFrame({"query_id": np.repeat(qids[a : a + 128], best.shape[1]), "id": ids[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    pairs = left.crossJoin(right)  # blocks by blocks: a stated query set against all rows
    return ranked(pairs.mapInPandas(run, "query_id bigint, id bigint, score double"), k)


def ivf_topk(library: DataFrame, queries: DataFrame, k: int, centers: np.ndarray, probes: int) -> DataFrame:
    """Inverted lists: every row is in the list of its nearest center; a query looks into its nearest `probes` lists."""
    _positive(k)
    c = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)

    def nearest(n: int):
        @F.pandas_udf("array<int>")
        def lists(v: pd.Series) -> pd.Series:
            m = np.stack([np.asarray(x, float) for x in v]) if len(v) else np.zeros((0, c.shape[1]))
            best = np.argsort(-(m @ c.T), axis=1)[:, :n].astype(np.int32)
            return pd.Series(list(best))

        return lists

    rows = library.select("id", "embedding", F.explode(nearest(1)("embedding")).alias("list"))
    asked = queries.select("query_id", F.col("embedding").alias("q"), F.explode(nearest(probes)("embedding")).alias("list"))
    return ranked(asked.join(rows, "list").select("query_id", "id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score")), k)


def kmeans_centers(library: DataFrame, lists: int, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Centers fitted on at most `sample` rows, those with the smallest hashes of their id."""
    v = library.orderBy(F.xxhash64("id")).select("embedding").limit(sample).toPandas()["embedding"]
    m = np.stack([np.asarray(x, float) for x in v])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    c = m[np.linspace(0, len(m) - 1, min(lists, len(m))).astype(int)].copy()
    for _ in range(rounds):
        own = (m @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = m[own == i].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


# ---------------------------------------------------------------- terms


def term_weights(library: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weights, stats): (query_id, term, idf) for queries (query_id, query), and one row (n_docs, avgdl); over all rows.

    Only terms that some query has are counted, once per row, and the counts are combined before their shuffle.
    """
    t = terms(F.col("text"))
    stats = library.select(F.size(t).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    seen = library.select(F.explode(F.array_distinct(t)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = asked.join(seen, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return weights, stats


def bm25_topk(library: DataFrame, queries: DataFrame, k: int, rows: DataFrame | None = None, k1: float = K1, b: float = B, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank) of `rows` (default: all) that share a term with the query; statistics are those of all rows.

    Rows become inverted blocks inside their tasks; a row block meets a query block once, both of bounded size, and only
    the block's own top k leave it, so the scores of single pairs are never shuffled.
    """
    _positive(k)
    weights, stats = term_weights(library, queries)
    n_blocks = max(1, -(-queries.count() // query_block))
    asked = weights.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list("query_id").alias("q"), F.collect_list("term").alias("t"), F.collect_list("idf").alias("w"))
    kept = (library if rows is None else rows).select("id", terms(F.col("text")).alias("terms"))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for i in range(0, len(df), row_block):
                part = df.iloc[i : i + row_block].sort_values("id")
                lists: dict[str, list] = {}
                for at, own in enumerate(part["terms"]):
                    for term, n in Counter(own).items():
                        lists.setdefault(term, []).append((at, n))
                index = {t: np.array(x, np.int32) for t, x in lists.items()}
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "dl": [np.array([len(x) for x in part["terms"]], np.int32).tobytes()], "index": [pickle.dumps(index, 5)]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples(index=False):
                ids, dl, index = np.frombuffer(r.ids, np.int64), np.frombuffer(r.dl, np.int32), pickle.loads(r.index)
                norm = k1 * (1 - b + b * dl / r.avgdl)
                own: dict[int, list] = {}
                for q, t, w in zip(r.q, r.t, r.w):
                    if t in index:
                        own.setdefault(int(q), []).append((t, w))
                parts = {}
                qs, out_ids, out_scores = [], [], []
                for q, found in own.items():
                    total = np.zeros(len(ids))
                    for t, w in found:
                        if t not in parts:
                            at, tf = index[t][:, 0], index[t][:, 1]
                            parts[t] = (at, tf * (k1 + 1) / (tf + norm[at]))
                        at, part = parts[t]
                        total[at] += w * part
                    some = np.flatnonzero(total > 0)
                    rounded = np.round(total[some], 6)
                    best = np.argsort(-rounded, kind="stable")[:k]  # ties by id, as the ids are in order
                    qs += [q] * len(best)
                    out_ids.append(ids[some[best]])
                    out_scores.append(rounded[best])
                if qs:
                    yield pd.DataFrame({"query_id": qs, "id": np.concatenate(out_ids), "score": np.concatenate(out_scores)})

    blocks = kept.filter("id IS NOT NULL").mapInPandas(invert, "ids binary, dl binary, index binary")
    pairs = blocks.crossJoin(asked.drop("block")).crossJoin(F.broadcast(stats.select("avgdl")))  # blocks by blocks
    return ranked(pairs.mapInPandas(score, "query_id bigint, id bigint, score double"), k)


# ---------------------------------------------------------------- filters


@dataclass(frozen=True)
class MetadataFilter:
    """What hits must be: unset parts don't constrain; undated rows pass a range of dates, which is compared as text."""

    publisher: str | None = None
    source_type: str | None = None
    category: str | None = None
    published_from: str | None = None
    published_to: str | None = None

    def is_empty(self) -> bool:
        return not any((self.publisher, self.source_type, self.category, self.published_from, self.published_to))

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.publisher:
            kept = "".join(c for c in self.publisher.strip().lower() if c.isascii() and (c.isalnum() or c in ".-")).removeprefix("www.")
            if kept:
                out = out & F.coalesce(F.lower("publisher").contains(kept), F.lit(False))
        for name in ("source_type", "category"):
            if value := getattr(self, name):
                out = out & F.coalesce(F.col(name) == value, F.lit(False))
        if self.published_from or self.published_to:
            d = F.col("published_date")
            within = F.lit(True)
            if self.published_from:
                within = within & (d >= self.published_from)
            if self.published_to:
                within = within & (d <= self.published_to)
            out = out & (within | d.isNull() | (d == ""))
        return out


@dataclass(frozen=True)
class SearchPlan:
    strategy: str = "hybrid_rrf"
    filter: MetadataFilter | None = None
    weights: tuple[float, float] | None = None

    def is_default(self) -> bool:
        return self.strategy == "hybrid_rrf" and not self.has_active_filter() and self.weights is None

    def has_active_filter(self) -> bool:
        return self.filter is not None and not self.filter.is_empty()


# ---------------------------------------------------------------- fusion


def _legs(library: DataFrame, queries: DataFrame, k: int, where: MetadataFilter | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that pass, dense leg, lexical leg): the filter comes before the pools, term statistics stay those of all rows."""
    pool = max(k, POOL)
    rows = library.filter(where.predicate()) if where and not where.is_empty() else library
    return rows, dense_topk_batch(rows, queries, pool), bm25_topk(library, queries, pool, rows)


def hybrid_rrf(library: DataFrame, queries: DataFrame, k: int, where: MetadataFilter | None = None) -> DataFrame:
    """Both legs fused by reciprocal rank; the reported score is the cosine. (query_id, id, score, rrf, rank)"""
    _positive(k)
    rows, dense, lexical = _legs(library, queries, k, where)
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    fused = dense.select("query_id", "id", F.col("rank").alias("d")).join(lexical.select("query_id", "id", F.col("rank").alias("l")), ["query_id", "id"], "full").select("query_id", "id", F.round(part("d") + part("l"), 9).alias("rrf"))
    best = ranked(fused, k, by="rrf")
    vectors = rows.select("id", "embedding").join(best.select("id").distinct(), "id", "left_semi")
    scored = best.join(vectors, "id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return scored.select("query_id", "id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score"), "rrf", "rank")


def hybrid_weighted(library: DataFrame, queries: DataFrame, k: int, weights: tuple[float, float] = WEIGHTS, where: MetadataFilter | None = None) -> DataFrame:
    """Both legs scaled to 0..1 within their pool (a leg of equal scores to 1) and summed by weight; a missing leg is 0."""
    _positive(k)
    _, dense, lexical = _legs(library, queries, k, where)
    q = Window.partitionBy("query_id")

    def scaled(leg: DataFrame, name: str) -> DataFrame:
        lo, hi = F.min("score").over(q), F.max("score").over(q)
        return leg.select("query_id", "id", F.when(hi == lo, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo)).alias(name))

    both = scaled(dense, "d").join(scaled(lexical, "l"), ["query_id", "id"], "full")
    score = F.round(weights[0] * F.coalesce("d", F.lit(0.0)) + weights[1] * F.coalesce("l", F.lit(0.0)), 6)
    return ranked(both.select("query_id", "id", score.alias("score")), k)


def search_plan(library: DataFrame, queries: DataFrame, plan: SearchPlan, k: int) -> DataFrame:
    """(query_id, id, score, rank, score_kind) by the plan's strategy, its filter before every leg."""
    where = plan.filter
    rows = library.filter(where.predicate()) if plan.has_active_filter() else library
    names = ["query_id", "id", "score", "rank"]
    if plan.strategy == "semantic":
        return dense_topk_batch(rows, queries, k).select(*names, F.lit(COSINE).alias("score_kind"))
    if plan.strategy == "lexical":
        return bm25_topk(library, queries, k, rows).select(*names, F.lit(BM25).alias("score_kind"))
    if plan.strategy == "hybrid_weighted":
        return hybrid_weighted(library, queries, k, plan.weights or WEIGHTS, where).select(*names, F.lit(NORMALIZED).alias("score_kind"))
    return hybrid_rrf(library, queries, k, where).select(*names, F.lit(COSINE).alias("score_kind"))


class UnsupportedStrategyError(ValueError):
    """A store can't search by the plan's strategy."""


def checked(plan: SearchPlan, supported: frozenset[str] = frozenset({"semantic", "lexical", "hybrid_rrf", "hybrid_weighted"})) -> SearchPlan:
    """The plan, if a store that supports these strategies can run it; the default plan runs on every store."""
    if not plan.is_default() and plan.strategy not in supported:
        raise UnsupportedStrategyError(plan.strategy)
    return plan


def parse_plan(response: Column) -> Column:
    """A plan from a model's answer: the text from the first brace to the last, as JSON; whatever can't be read is default.

    Unknown strategies are `hybrid_rrf`, blank filter strings are unset, weights only count for `hybrid_weighted`.
    """
    kind = "struct<strategy:string,filter:struct<publisher:string,source_type:string,category:string,published_from:string,published_to:string>,weights:array<double>>"
    p = F.from_json(F.regexp_extract(F.coalesce(response, F.lit("")), r"(?s)(\{.*\})", 1), kind)
    strategy = F.when(p["strategy"].isin("semantic", "lexical", "hybrid_rrf", "hybrid_weighted"), p["strategy"]).otherwise("hybrid_rrf")
    part = lambda c: F.nullif(F.trim(p["filter"][c]), F.lit("")).alias(c)
    weights = F.when((strategy == "hybrid_weighted") & (F.size(p["weights"]) == 2), p["weights"])
    return F.struct(strategy.alias("strategy"), *[part(c) for c in ("publisher", "source_type", "category", "published_from", "published_to")], weights.alias("weights"))


def retrieve_corpus(library: DataFrame, queries: DataFrame, plan: SearchPlan, k: int, least_chars: int = 200, thresholds: dict[str, float] | None = None, reranker=None) -> DataFrame:
    """Search, short texts out, thresholds, then the reranker: thresholds never see its scores. (query_id, id, score, score_kind, rank)"""
    pool = max(30, k) if reranker is not None else k
    hits = search_plan(library, queries, checked(plan), pool * 6).join(library.select("id", "text"), "id")
    hits = threshold(min_chars(hits, least_chars, pool), thresholds if thresholds is not None else {COSINE: 0.0})
    if reranker is None:
        return hits.filter(F.col("rank") <= k).drop("text")
    return rerank(hits.join(queries.select("query_id", "query"), "query_id"), reranker(F.col("query"), F.col("text")), k).drop("text", "query")


def search_plans(library: DataFrame, queries: DataFrame, plans: dict[str, SearchPlan], k: int) -> DataFrame:
    """Plans as data: queries (query_id, ..., plan) go by the plan they name; a union of one branch per plan."""
    out = None
    for name, plan in plans.items():
        part = search_plan(library, queries.filter(F.col("plan") == name), plan, k).withColumn("plan", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- after the search


def min_chars(hits: DataFrame, least: int, k: int) -> DataFrame:
    """Short texts go, the next ones move up; a query whose hits are all short keeps them. (query_id, id, text, score, rank)"""
    long = F.length("text") >= least
    kept = hits.withColumn("n_long", F.count_if(long).over(Window.partitionBy("query_id"))).filter(long | (F.col("n_long") == 0))
    again = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("int")).filter(F.col("rank") <= k)
    return again.drop("n_long")


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in reranker: the share of the query's terms that the text has."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, terms(text))) / F.size(q), 6)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """The score replaced and the order renewed, ties keep their rank."""
    _positive(k)
    new = hits.withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("score_kind", F.lit(RERANK))


def threshold(hits: DataFrame, least: dict[str, float]) -> DataFrame:
    """Hits below their kind's threshold go; kinds without one stay, and hits of no kind count as cosine."""
    kind = F.coalesce("score_kind", F.lit(COSINE))
    keep = F.lit(True)
    for name, value in least.items():
        keep = keep & ((kind != name) | (F.col("score") >= value))
    return hits.filter(keep)


def session_first(session: DataFrame, shared: DataFrame, k: int) -> DataFrame:
    """Hits of the session's documents before the shared ones, each by score; an id counts once, the session's first."""
    both = session.withColumn("tier", F.lit(0)).unionByName(shared.withColumn("tier", F.lit(1)))
    once = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("tier", F.desc("score")))).filter("n = 1").drop("n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "id"))).filter(F.col("rank") <= k)


def gather(session: DataFrame, shared: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The shared leg only for queries whose session hits are fewer than k."""
    few = queries.select("query_id").join(session.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    return session_first(session, shared.join(few.select("query_id"), "query_id", "left_semi"), k)


def broaden(filtered: DataFrame, free: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries without any hit under their filter take the hits without it."""
    none = queries.select("query_id").join(filtered.select("query_id").distinct(), "query_id", "left_anti")
    return filtered.withColumn("broadened", F.lit(False)).unionByName(free.join(none, "query_id", "left_semi").withColumn("broadened", F.lit(True)))


def neighbour_window(hits: DataFrame, chunks: DataFrame, radius: int, same_section: bool = False) -> DataFrame:
    """(query_id, id, text): each hit's text with its neighbours in reading order, as far as they are contiguous.

    An equi-join on (source, chunk_index) with 2 * radius + 1 rows per hit; a gap ends the window on its side.
    """
    asked = hits.select("query_id", "id", "source", "chunk_index", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - radius), F.col("chunk_index") + radius)).alias("at"))
    found = asked.join(chunks.select("source", F.col("chunk_index").alias("at"), "text", *(["section"] if same_section else [])), ["source", "at"])
    own = Window.partitionBy("query_id", "id").orderBy("at")
    if same_section:
        center = F.max(F.when(F.col("at") == F.col("chunk_index"), F.coalesce("section", F.lit("")))).over(Window.partitionBy("query_id", "id"))
        found = found.withColumn("center", center).filter(F.coalesce("section", F.lit("")) == F.col("center"))
    # Contiguous rows share at - row_number; those of the hit's own run stay.
    runs = found.withColumn("run", F.col("at") - F.row_number().over(own)).withColumn("mine", F.max(F.when(F.col("at") == F.col("chunk_index"), F.col("run"))).over(Window.partitionBy("query_id", "id")))
    kept = runs.filter(F.col("run") == F.col("mine"))
    return kept.groupBy("query_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.min("at").alias("first_index"), F.max("at").alias("last_index"))


def expand(hits: DataFrame, chunks: DataFrame, radius: int = 1, max_chunks: int = 5, same_section: bool = False) -> DataFrame:
    """Neighbour expansion with consumption: in the order of rank, a hit whose own chunk an earlier hit took is dropped,
    and neighbours already taken are left out. (query_id, id, rank, text, n_chunks)

    A window ends at a gap and, with `same_section`, where the section (a column of `chunks`) is another than that of a
    hit that has one. Empty texts leave no blank paragraph. The fold is over one query's hits, at most a search's k; the
    neighbours come by an equi-join.
    """
    r = min(radius, (max_chunks - 1) // 2)
    asked = hits.select("query_id", "id", "rank", "source", "chunk_index", "text")
    around = F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - r), F.col("chunk_index") + r)
    span = asked.select("source", F.explode(around).alias("at")).distinct()
    section = F.col("section") if same_section else F.lit(None).cast("string")
    near = span.join(chunks.select("source", F.col("chunk_index").alias("at"), F.col("text").alias("t"), section.alias("s")).dropDuplicates(["source", "at"]), ["source", "at"])
    windows = asked.select("query_id", "id", "source", F.explode(around).alias("at")).join(near, ["source", "at"]).groupBy("query_id", "id").agg(F.collect_list(F.struct("at", "t", "s")).alias("near"))
    rows = asked.join(windows, ["query_id", "id"], "left")

    def fold(hits: list) -> list[tuple]:
        taken: set = set()
        out = []
        for h in hits:
            if h.source is None or h.chunk_index is None or h.chunk_index != h.chunk_index:
                out.append((h.query_id, h.id, h.rank, h.text, 1))
                continue
            at = int(h.chunk_index)
            if (h.source, at) in taken:
                continue
            found = {int(x["at"]): (x["t"], x["s"]) for x in (h.near if h.near is not None else ())}
            own_text, own_section = found.get(at, (None, None))
            found[at] = (h.text if own_text is None else own_text, own_section)
            reach = [at]
            for step in (-1, 1):
                i = at + step
                while i in found and abs(i - at) <= r and not (own_section and found[i][1] != own_section):
                    reach.append(i)
                    i += step
            own = sorted(i for i in reach if (h.source, i) not in taken)
            taken |= {(h.source, i) for i in own}
            texts = [t for i in own if (t := found[i][0])]
            out.append((h.query_id, h.id, h.rank, "\n\n".join(texts) if texts else h.text, len(own)))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    return fold_groups(rows, "query_id", ["rank", "id"], fold, f"query_id {kinds['query_id']}, id {kinds['id']}, rank int, text string, n_chunks int")
