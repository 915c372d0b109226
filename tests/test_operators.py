import itertools
import json
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import storage
from corvane.functions import text
from corvane.operators import agents, chunking, evaluate, grounding, ingest, search
from corvane.plans.queries import QUERIES
from corvane.sources import files
from corvane.streaming import queue
from corvane.tables import table
from tests.conftest import DATA


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- chunking


def plain_chunks(text, size=chunking.SIZE, overlap=chunking.OVERLAP):
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size - overlap) if i == 0 or i + overlap < len(w)]


def joined_small(pieces, least):
    """By runs of small pieces: each run is cut as soon as what is gathered reaches the floor."""
    out = []
    for small, run in itertools.groupby(pieces, lambda p: len(p) < least):
        held = []
        for p in run:
            if not held and not p:
                continue
            held.append(p)
            if not small or len("\n\n".join(held)) >= least:
                out.append("\n\n".join(held))
                held = []
        if held and "\n\n".join(held):
            out.append("\n\n".join(held))
    return out


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201, 380, 381, 1000])
def test_word_chunks_like_plain(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    got = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [r.text for r in chunking.chunk_text(got).orderBy("chunk_index").collect()] == plain_chunks(text)


def test_bad_sizes():
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_text(None, "a", "b", size, overlap)


def test_sections():
    text = "lead\n# A\n## B\nbody\n#no heading\n### C ###\nend"
    assert chunking.blocks(text, "start") == [("start", "lead"), ("B", "# A\n## B\nbody\n#no heading"), ("C", "### C ###\nend")]


def test_atomic_blocks():
    text = "a b\n| x |\n|---|\n| 1 |\nc\n```\ncode | x\n```\n| single"
    assert [a for a, _ in chunking.segments(text)] == [False, True, False, True, False]
    assert chunking.pieces("| a |\n| b |", 1, 0) == ["| a |\n| b |"]
    assert chunking.segments("| a\n| b") == [(False, "| a\n| b")] and chunking.segments("```\n| a |\n~~~\nx\r\n| one |") == [(True, "```\n| a |\n~~~"), (False, "x\n| one |")]


@pytest.mark.parametrize("pieces", [[], ["aa"], ["aaaaa"], ["a", "b", "cccccc", "d"], ["aaa", "bbb", "c"], ["", "aaaaaa", "", "b", ""]])
def test_coalesce_fold_like_plain(spark, pieces):
    df = spark.createDataFrame([(pieces,)], "p array<string>").select(chunking.coalesce_small(F.col("p"), 5).alias("x"))
    assert df.head()["x"] == joined_small(pieces, 5)


def test_pages_carry_sections(spark):
    df = spark.createDataFrame([("s", ["# A\none", None, "two\n# B\nthree"])], "source string, pages array<string>")
    assert [(r.chunk_index, r.page, r.section) for r in chunking.ingest_pages(df).collect()] == [(0, 1, "A"), (1, 3, "A"), (2, 3, "B")]


# ---------------------------------------------------------------- search

LIB = "id bigint, embedding array<float>"


def test_dense_order_and_ties(spark):
    lib = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 2.0]), (5, [0.0, 0.0])], LIB)
    q = spark.createDataFrame([(7, [0.0, 1.0]), (8, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    got = {k: [r.id for r in search.dense_topk_batch(lib, q, 3, row_block=2).filter(F.col("query_id") == k).orderBy("rank").collect()] for k in (7, 8)}
    assert got == {7: [2, 3, 4], 8: [1, 2, 3]}
    assert [r.id for r in search.dense_topk(lib, [0.0, 1.0], 3).collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        search.dense_topk(lib, [0.0, 1.0], 0)


def test_blocks_like_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    lib = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], LIB).repartition(3)
    q = lib.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, 300, 20) for j in np.lexsort((np.arange(300), -np.round(u @ u[i], 6)))[:5]}
    assert {(r.query_id, r.id) for r in search.dense_topk_batch(lib, q, 5, row_block=37, query_block=4).collect()} == want


def test_ivf_recall(spark):
    rng = np.random.default_rng(2)
    m = (rng.normal(size=(8, 16))[rng.integers(0, 8, 400)] * 2 + rng.normal(size=(400, 16))).astype(np.float32)
    lib = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], LIB)
    q = lib.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id) for r in search.dense_topk_batch(lib, q, 10).collect()}
    near = {(r.query_id, r.id) for r in search.ivf_topk(lib, q, 10, search.kmeans_centers(lib, 8), 3).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_filter(spark):
    df = spark.createDataFrame([(1, "Acme.org", "x", "2024-03-15"), (2, None, "x", None), (3, "acme.org", "y", "2024")], "id int, publisher string, category string, published_date string")
    keep = lambda **k: [r.id for r in df.filter(search.MetadataFilter(**k).predicate()).orderBy("id").collect()]
    assert keep() == [1, 2, 3]
    assert keep(publisher=" www.ACME%") == [1, 3]
    assert keep(published_to="2024") == [2, 3]
    assert keep(category="x", published_from="2025") == [2]
    assert search.SearchPlan().is_default() and not search.SearchPlan("lexical").is_default() and search.SearchPlan(filter=search.MetadataFilter()).is_default()


def test_min_chars_keeps_all_short(spark):
    h = spark.createDataFrame([(1, 1, "long text", 0.9, 1), (1, 2, "x", 0.8, 2), (1, 3, "more text", 0.7, 3), (2, 4, "y", 0.9, 1)], "query_id int, id int, text string, score double, rank int")
    assert rows(search.min_chars(h, 5, 2).select("query_id", "id", "rank")) == [(1, 1, 1), (1, 3, 2), (2, 4, 1)]


def test_session_first(spark):
    k = "query_id int, id int, score double"
    a, b = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.5)], k), spark.createDataFrame([(1, 1, 0.9), (1, 3, 0.8)], k)
    assert [r.id for r in search.session_first(a, b, 3).orderBy("rank").collect()] == [2, 1, 3]
    assert [r.id for r in search.gather(a, b, a.select("query_id").distinct(), 2).orderBy("rank").collect()] == [2, 1]


def test_threshold_by_kind(spark):
    h = spark.createDataFrame([(1, "cosine", -0.1), (2, "bm25", 0.0), (3, None, 0.2), (4, "normalized", 0.0)], "id int, score_kind string, score double")
    assert [r.id for r in search.threshold(h, {"cosine": 0.0, "bm25": 1.0}).orderBy("id").collect()] == [3, 4]


def test_expansion_consumes(spark):
    chunks = spark.createDataFrame([("a", i, f"A{i}") for i in (0, 1, 2, 3, 5)], "source string, chunk_index int, text string")
    hits = spark.createDataFrame([(1, "x", 1, "a", 1, "A1"), (1, "y", 2, "a", 2, "A2"), (1, "z", 3, "a", 3, "A3"), (1, "w", 4, "a", 5, "A5"), (1, "n", 5, None, None, "own")], "query_id int, id string, rank int, source string, chunk_index int, text string")
    got = {r.id: r.text for r in search.expand(hits, chunks).collect()}
    assert got == {"x": "A0\n\nA1\n\nA2", "z": "A3", "w": "A5", "n": "own"}


# ---------------------------------------------------------------- grounding, metrics


def test_gate(spark):
    df = spark.createDataFrame([(1, "a [1]", 1), (2, "a [3]", 1), (3, "a", 0), (4, None, 2)], "seq int, answer string, n_hits int")
    got = {r.seq: (r.grounded, r.reason, r.abstention is not None) for r in grounding.gate(df).collect()}
    assert got == {1: (True, "", False), 2: (False, "citations outside context 1-1: [3]", False), 3: (False, "no supporting context", True), 4: (True, "", False)}


def test_merge_sources(spark):
    df = spark.createDataFrame([("r", "b", 1, "x"), ("r", "a", 2, "y"), ("r", "b", 3, "z"), ("r", "b", 4, "x")], "run_id string, label string, seq int, text string")
    assert rows(grounding.merge_sources(df)) == [("r", "a", 2, "y"), ("r", "b", 1, "x\n\nz")]


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int")
    g = spark.createDataFrame([(1, "b"), (1, "z"), (1, "b")], "query_id int, id string")
    assert rows(evaluate.metrics(evaluate.judged(q, r, g), 2)) == [(1, 0.5, 0.5, True, 0.5), (2, 0.0, 0.0, False, 0.0)]


def test_p95_is_nearest_rank(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    assert evaluate.latency_summary(df, "v").head()["p95"] == 10.0


# ---------------------------------------------------------------- ingest


def test_recovery(spark):
    header = "The Running Header"
    pages = [("s", i, "kept line of text", f"{header}\nkept  line of text!\nlost line number {w}\n12 34\nlost line number {w}") for i, w in enumerate(["one", "two", "three", "four"])]
    df = spark.createDataFrame(pages, "source string, page int, layout_text string, plain_text string")
    assert rows(ingest.recover_dropped(df).select("page", "recovered")) == [(i, f"lost line number {w}") for i, w in enumerate(["one", "two", "three", "four"])]


def test_figures(spark):
    mark = "<!-- image -->"
    f = lambda page, texts: spark.createDataFrame([(page, texts)], "p string, t array<string>").select(ingest.inject_figures(F.col("p"), F.col("t")).alias("x")).head()["x"]
    assert f(f"a{mark}b{mark}c", ["X", ""]) == "a\n\nX\n\nbc"
    assert f(f"a{mark}b", ["X", "Y"]) == "ab\n\nX\n\nY"
    assert f("ab", []) == "ab"


def test_greedy_pack(spark):
    df = spark.createDataFrame([("r", i, n) for i, n in enumerate([5, 5, 1, 20, 3, 7])] + [("q", 0, 9)], "run_id string, seq bigint, bytes bigint")
    assert rows(ingest.greedy_pack(df, 10)) == [("q", 0, 0), ("r", 0, 0), ("r", 1, 0), ("r", 2, 1), ("r", 3, 2), ("r", 4, 3), ("r", 5, 3)]


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, seq int")
    c = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    assert rows(ingest.upsert(t, c).select("id", "v")) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(ingest.delete_by(t, "v", spark.createDataFrame([("a",)], "v string")).select("id")) == [(2,)]


def test_delta(spark):
    k = "source string, content_hash string"
    now, was = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], k), spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], k)
    assert rows(ingest.delta(now, was)) == [("a", "new"), ("b", "changed"), ("c", "unchanged"), ("d", "removed")]


def test_positional_rejects(spark):
    f = spark.createDataFrame([(1, "a")], "pos bigint, source string")
    m = spark.createDataFrame([(1, " ", "WWW.X.org"), (2, "c", "y")], "pos bigint, category string, publisher string")
    with pytest.raises(ValueError):
        ingest.positional(f, m, {})
    assert rows(ingest.positional(f, m.filter("pos = 1"), {"category": "dflt"})) == [(1, "a", "dflt", "x.org")]


# ---------------------------------------------------------------- agents, streams, sources


@pytest.mark.parametrize("small", [5000, 0])
def test_waves(spark, monkeypatch, small):
    monkeypatch.setattr(agents, "SMALL_PLAN", small)
    plans = [("d", "a", []), ("d", "b", ["a"]), ("d", "c", ["a"]), ("d", "e", ["b", "c"]), ("x", "a", ["b"]), ("x", "b", ["a"]), ("x", "c", None), ("u", "a", ["zz"])]
    df = spark.createDataFrame(plans, "run_id string, node_id string, depends_on array<string>")
    assert rows(agents.dag_waves(df)) == [("d", "a", 0), ("d", "b", 1), ("d", "c", 1), ("d", "e", 2), ("x", "c", 0)]
    assert rows(agents.dag_valid(df)) == [("d", 4, True), ("u", 1, False), ("x", 3, False)]


def test_queue(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    ev = [("a", t(0), "enqueued"), ("b", t(0), "claimed"), ("c", t(0), "claimed"), ("c", t(1), "acked"), *[("d", t(i), "claimed") for i in range(4)], ("e", t(9), "claimed")]
    st = agents.task_state(spark.createDataFrame(ev, "task_id string, ts timestamp, event string"))
    assert {r.task_id: r.state for r in st.collect()} == {"a": "pending", "b": "inflight", "c": "done", "d": "dead", "e": "inflight"}
    assert [r.task_id for r in agents.reclaimable(st, F.lit(t(10))).collect()] == ["b"]


def test_schedule(spark):
    ticks = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, m)) for m in (0, 5, 12, 20, 23)], "k string, ts timestamp")
    assert [r.ts.minute for r in agents.schedule_due(ticks, "k", "ts", 10).orderBy("ts").collect()] == [0, 12, 23]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = [("a", datetime(2024, 1, 1), "claimed"), ("a", datetime(2024, 1, 1), "acked"), ("b", datetime(2024, 1, 1), "enqueued")]
    spark.createDataFrame(batch, "task_id string, ts timestamp, event string").write.parquet(src)
    stream = spark.readStream.schema("task_id string, ts timestamp, event string").parquet(src)
    got = []
    q = queue.task_states(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.task_id: r.state for r in got} == {"a": "done", "b": "pending"}
    sink = queue.idempotent_sink(out, "task_id", lambda df: df.select("task_id"))
    df = spark.createDataFrame([("a",), ("b",)], "task_id string")
    sink(df, 0)
    sink(df, 0)
    sink(spark.createDataFrame([("b",), ("c",)], "task_id string"), 1)
    assert sorted(r.task_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_sources(spark, tmp_path):
    (tmp_path / "Cat").mkdir()
    (tmp_path / "Cat" / "a.TXT").write_text("hello", encoding="utf-8")
    (tmp_path / "b.xyz").write_text("no")
    (tmp_path / "bad.docx").write_bytes(b"broken")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    walked = files.walk(spark, str(tmp_path))
    got = {r.source: r for r in files.load(walked).collect()}
    assert set(got) == {"Cat/a.TXT", "bad.docx", "d.docx"}
    assert got["Cat/a.TXT"].pages == ["hello"] and got["Cat/a.TXT"].title == "a"
    assert got["d.docx"].pages == ["one\ntwo"] and got["bad.docx"].error
    assert {r.source: r.category for r in walked.collect()}["Cat/a.TXT"] == "Cat"
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "1", "query": "x", "gold_needles": ["y"]}]}))
    assert files.gold_queries(spark, str(tmp_path / "q.json")).head()["query"] == "x"
    (tmp_path / "manifest.csv").write_text("Filename,source_domain,year_score\nx.pdf,a.org,2020\n")
    m = files.manifest(spark, str(tmp_path / "manifest.csv")).head()
    assert (m.filename, m.domain, m.detected_year, m.year_score) == ("x.pdf", "a.org", None, "2020")


def test_fan_out(spark, tmp_path):
    df = spark.range(3)
    assert ingest.fan_out(df, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 3
    with pytest.raises(ValueError):
        ingest.fan_out(df, [])
    assert files.migrate(spark.createDataFrame([("x",), ("",)], "text string"), str(tmp_path / "m"), 1) == 1


def test_bm25_like_brute_force(spark):
    import math
    from collections import Counter

    texts = ["the cat sat on the mat", "the dog", "", None, "cat cat dog", "the the the", "Über-größe cat", "mat"]
    lib = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(2)
    q = spark.createDataFrame([(1, "CAT the the"), (2, "dog größe"), (3, "nothing"), (4, None)], "query_id bigint, query string")
    docs = [(t or "").lower().replace("-", " ").split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    want = set()
    for qid, query in ((1, {"cat", "the"}), (2, {"dog", "größe"})):
        scores = {}
        for i, d in enumerate(docs):
            tf = Counter(d)
            for t in query & tf.keys():
                df = sum(t in x for x in docs)
                scores[i] = scores.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / avg))
        for rank, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:3], 1):
            want.add((qid, i, round(scores[i], 6), rank))
    assert {tuple(r) for r in search.bm25_topk(lib, q, 3, row_block=3, query_block=1).collect()} == want
    assert search.bm25_topk(lib.limit(0), q, 3).count() == 0


def test_groups_across_batches(spark):
    from corvane.operators.groups import fold_groups

    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = fold_groups(df, "k", ["v"], lambda rows: [(rows[0].k, len(rows), rows[0].v)], "k bigint, n int, first bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(k, len(range(k, 1000, 7)), k) for k in range(7)]


def test_log_queries_read_every_event(spark):
    events = table(spark, DATA, "events")
    got = QUERIES["run_view"](spark, DATA).collect()
    assert sum(r.n_events for r in got) == events.count() and len(got) == events.select("user_id", F.dayofmonth("ts")).distinct().count()


def test_ivf_searches_every_vector(spark):
    v = table(spark, DATA, "embeddings").select("vec_id").collect()
    got = QUERIES["ivf_topk"](spark, DATA).collect()
    assert {r.query_id for r in got} == {r.vec_id for r in v if r.vec_id % 20 == 0}
    assert {(r.query_id, r.rank) for r in got if r.id == r.query_id} == {(r.vec_id, 1) for r in v if r.vec_id % 20 == 0}
    recall = QUERIES["ivf_recall"](spark, DATA).head()
    assert recall.n_exact == 10 * len({r.query_id for r in got}) and recall.n_found > 0


# ---------------------------------------------------------------- expansion, recovery, changes


def test_expansion_keeps_to_the_section_and_skips_blank_texts(spark):
    chunks = spark.createDataFrame([("s", 0, "a", "one"), ("s", 1, "", "one"), ("s", 2, "c", "one"), ("s", 3, "d", "two"), ("s", 5, "f", "two")], "source string, chunk_index int, text string, section string")
    hits = spark.createDataFrame([(1, "h2", 1, "s", 2, "c"), (1, "h0", 2, "s", 0, "a"), (1, "h1", 3, "s", 1, ""), (1, "h5", 4, "s", 5, "f"), (1, "hx", 5, None, None, "x")], "query_id int, id string, rank int, source string, chunk_index int, text string")
    assert rows(search.expand(hits, chunks).select("id", "text", "n_chunks")) == [("h0", "a", 1), ("h2", "c\n\nd", 3), ("h5", "f", 1), ("hx", "x", 1)]
    assert rows(search.expand(hits, chunks, same_section=True).select("id", "text", "n_chunks")) == [("h0", "a", 1), ("h2", "c", 2), ("h5", "f", 1), ("hx", "x", 1)]
    assert search.expand(hits.limit(0), chunks).count() == 0


def test_recovered_lines(spark):
    pages = [("s", 0, "Kept heading text", "Kept  heading\u2028A dropped   footnote here\r\n12 34\nA dropped footnote here"), ("s", 1, None, None)]
    df = spark.createDataFrame(pages, "source string, page int, layout_text string, plain_text string")
    assert rows(ingest.recover_dropped(df)) == [("s", 0, "A dropped footnote here"), ("s", 1, "")]


def test_changes_of_files(spark):
    library = spark.createDataFrame([("a", 0, "old a"), ("b", 0, "old b"), ("gone", 0, "old")], "source string, chunk_index int, text string")
    state = spark.createDataFrame([("a", "1"), ("b", "1"), ("gone", "1")], "source string, content_hash string")
    files = spark.createDataFrame([("a", "1", "new a"), ("b", "2", "new b"), ("c", "3", "new c"), ("d", "4", None)], "source string, content_hash string, text string")
    cut = lambda f: chunking.chunk_text(f, "source")
    chunks, after, outcome = ingest.apply_changes(library, state, files, cut)
    assert rows(chunks) == [("a", 0, "old a"), ("b", 0, "new b"), ("c", 0, "new c"), ("gone", 0, "old")]
    assert rows(outcome) == [("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "failed")]
    again = ingest.apply_changes(chunks, after, files, cut)
    assert rows(again[0]) == rows(chunks) and {r.action for r in again[2].collect()} == {"unchanged", "failed"}


def test_manifest_names_are_exact(spark):
    files = spark.createDataFrame([("f/A.pdf", "f"), ("f/a.pdf", "f")], "source string, folder string")
    m = spark.createDataFrame([("f", "x\\a.pdf", "p", 2020, 1, 1), ("f", "a.pdf", "q", 2021, 1, 2)], "folder string, filename string, publisher string, published_year int, manifest_id int, line_no int")
    assert {r.source: r.publisher for r in ingest.manifest_join(files, m).collect()} == {"f/A.pdf": None, "f/a.pdf": "q"}


def test_conversations_grow_and_are_renamed(spark):
    m = spark.createDataFrame([(3, "c", "q", 1)], "seq bigint, conversation_id string, question string, created_at int")
    t = spark.createDataFrame([("c", "later", 9), ("c", "next", 5), ("n", "first", 1)], "conversation_id string, question string, created_at int")
    assert rows(agents.append_turns(m, t).select("conversation_id", "seq", "question")) == [("c", 3, "q"), ("c", 4, "next"), ("c", 5, "later"), ("n", 1, "first")]
    c = spark.createDataFrame([("c", "old", "me"), ("d", "old", None)], "conversation_id string, title string, owner_id string")
    assert rows(agents.rename_conversation(c, "c", "new")) == [("c", "new", "me"), ("d", "old", None)]
    assert agents.owned(c, "me").count() == 1 and agents.owned(c, None).count() == 2
    kept, left = agents.delete_conversation(c, m, "c")
    assert [r.conversation_id for r in kept.collect()] == ["d"] and left.count() == 0


def test_citations_of_any_length(spark):
    df = spark.createDataFrame([("a [1] [12345678901] [99999999999999999999]", 2)], "answer string, n_hits int")
    assert df.select(text.invalid_citations(F.col("answer"), F.col("n_hits")).alias("x")).head()["x"] == [12345678901, 2**63 - 1]


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
