"""Every query of the core by name: (SparkSession, folder of tables) -> DataFrame, and the SQL that gives the same rows.

The library of these queries: every document is a row; its vector is that of `vec_id = doc_id mod n`, n being
the number of vectors. Queries of a
search are the rows whose id is divisible by 20, against all rows. vectors_topk and the IVF queries search the
embeddings table itself, every vector of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as X
from corvane.operators import agents, chunking, drift, evaluate, grounding, ingest, search
from corvane.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{LIB}", _LIB).replace("{DENSE}", _DENSE).replace("{BM25}", _BM25).replace("{LAST}", _LAST).replace("{TASKS}", _TASKS)
        return f

    return add


_LIB = """lib AS (SELECT d.doc_id AS id, d.text, d.title, d.category, d.published_date, d.source AS publisher, e.embedding::DOUBLE[] AS emb
    FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)),
  q AS (SELECT id AS query_id, title AS query, emb AS qemb FROM lib WHERE id % 20 = 0)"""
_DENSE = """dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT query_id, id, round(list_cosine_similarity(emb, qemb), 6) + 0.0 AS score FROM lib, q))"""
_TERMS = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_BM25 = f"""toks AS (SELECT id, {_TERMS.format("text")} AS t FROM lib),
  stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
  post AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM toks) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  asked AS (SELECT query_id, unnest(list_distinct({_TERMS.format("query")})) AS term FROM q),
  lex AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM asked JOIN df USING (term) JOIN post USING (term), stats GROUP BY query_id, id),
  bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex)"""
_LAST = "m AS (SELECT DISTINCT seq, conversation_id, question, answer FROM messages)"
_TASKS = """ev AS (SELECT user_id * 100 + day(ts) AS task_id, ts, CASE event_type WHEN 'signup' THEN 'enqueued' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'acked' ELSE event_type END AS event FROM events),
  st AS (SELECT task_id, count(*) FILTER (event = 'claimed') AS attempts, count(*) FILTER (event = 'acked') AS acks, max(ts) AS last_ts FROM ev GROUP BY task_id),
  state AS (SELECT task_id, CASE WHEN acks > 0 THEN 'done' WHEN attempts > 3 THEN 'dead' WHEN attempts > 0 THEN 'inflight' ELSE 'pending' END AS state, attempts, last_ts FROM st)"""


def library(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    n = max(1, vectors.count())  # from the file's footers
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "title", "category", "published_date", F.col("source").alias("publisher"), F.pmod("doc_id", F.lit(n)).alias("v"))
    return docs.join(vectors, "v").drop("v").withColumn("source_type", X.classify_source_type(F.regexp_replace("publisher", r"\.example$", "")))


def asked(lib: DataFrame) -> DataFrame:
    return lib.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("query"), "embedding")


_WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


# ---------------------------------------------------------------- drifting files


def _cells(text: str) -> str:
    """SQL for the cells of a line, with its delimiter in d."""
    one = lambda c, e: f"regexp_extract_all({c} || {text}, '{e}( *\"(?:[^\"]|\"\")*\" *|[^{e}]*)', 1)"
    split = f"CASE d WHEN ',' THEN {one(chr(39) + ',' + chr(39), ',')} WHEN ';' THEN {one(chr(39) + ';' + chr(39), ';')} ELSE {one('chr(9)', chr(92) + 't')} END"
    bare = "regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
    split = f"list_transform({split}, lambda x: {bare})"
    return f"list_transform({split}, lambda x: CASE WHEN trim(x) LIKE '\"%\"' THEN trim(replace(trim(trim(x), '\"'), '\"\"', '\"')) ELSE trim(x) END)"


_ALIASES = ", ".join(f"'{a}': '{k}'" for k, v in drift.ALIASES.items() for a in (*v, k))
_P1 = f"""WITH l AS (SELECT DISTINCT manifest_id, line_no, replace(coalesce(line_text, ''), chr(65279), '') AS t FROM manifest_lines),
  u AS (SELECT * FROM l WHERE regexp_matches(t, '[^ \\t]') AND NOT regexp_matches(t, '^[ \\t]*#')),
  h AS (SELECT manifest_id, min(line_no) AS hn, arg_min(t, line_no) AS ht FROM u GROUP BY 1),
  g AS (SELECT *, CASE WHEN length(replace(ht, ',', '')) <= least(length(replace(ht, ';', '')), length(replace(ht, chr(9), ''))) THEN ',' WHEN length(replace(ht, ';', '')) <= length(replace(ht, chr(9), '')) THEN ';' ELSE chr(9) END AS d FROM h),
  n AS (SELECT manifest_id, hn, d, list_transform({_cells("ht")}, lambda x: lower(x)) AS names FROM g),
  r AS (SELECT manifest_id, names, c FROM (SELECT u.manifest_id, names, {_cells("t")} AS c FROM u JOIN n USING (manifest_id) WHERE line_no > hn) WHERE list_transform(c, lambda x: lower(x)) <> names),
  v AS (SELECT manifest_id, names[i] AS name, c[i] AS v FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM r) WHERE c[i] <> ''),
  k AS (SELECT manifest_id, name, CASE WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(regexp_full_match(v, '[+-]?([0-9]+|[0-9]*\\.[0-9]+)')) THEN 'decimal' WHEN bool_and(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) THEN 'date' ELSE 'text' END AS kind FROM v GROUP BY ALL),
  f AS (SELECT manifest_id, name, coalesce(MAP {{{_ALIASES}}}[name], name) AS field_name, kind FROM (SELECT manifest_id, unnest(names) AS name FROM n) LEFT JOIN k USING (manifest_id, name)),
  o AS (SELECT manifest_id, lag(manifest_id) OVER (PARTITION BY folder ORDER BY collected_at, manifest_id) AS before FROM (SELECT DISTINCT manifest_id, folder, collected_at FROM manifest_files)),
  a AS (SELECT o.manifest_id, field_name, name, kind FROM o JOIN f USING (manifest_id) WHERE before IS NOT NULL), b AS (SELECT o.manifest_id, field_name, name, kind FROM o JOIN f ON f.manifest_id = before)
  SELECT manifest_id, field_name, drift FROM (SELECT manifest_id, field_name, unnest([CASE WHEN b.name IS NULL THEN 'added' END, CASE WHEN a.name IS NULL THEN 'removed' END,
    CASE WHEN a.name <> b.name AND field_name IN ('status', 'url', 'filename', 'domain', 'detected_year', 'size_bytes', 'sha256', 'error') THEN 'renamed' END, CASE WHEN a.kind <> b.kind THEN 'type_changed' END]) AS drift
    FROM a FULL JOIN b USING (manifest_id, field_name)) WHERE drift IS NOT NULL"""


@query(_P1)
def p1_found(spark, d):
    return drift.drift(table(spark, d, "manifest_files"), table(spark, d, "manifest_lines"))


@query()
def p1_records(spark, d):
    return drift.records(table(spark, d, "manifest_files"), table(spark, d, "manifest_lines"))


@query()
def p1_failed_casts(spark, d):
    return drift.failed_casts(table(spark, d, "manifest_files"), table(spark, d, "manifest_lines"))


# ---------------------------------------------------------------- text and metadata


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key FROM documents")
def dedup_key(spark, d):
    return table(spark, d, "documents").select("doc_id", X.dedup_key(F.col("title")).alias("key"))


@query("SELECT doc_id, length(regexp_replace(title, '[^\\p{L}]', '', 'g')) AS letters FROM documents")
def letter_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.letter_count(F.col("title")).alias("letters"))


@query("SELECT DISTINCT source, CASE WHEN contains(source, '/') THEN split_part(source, '/', 1) ELSE 'uncategorized' END AS category, list_extract(string_split(replace(source, '\\', '/'), '/'), -1) AS name FROM chunks")
def path_category(spark, d):
    s = F.col("source")
    return table(spark, d, "chunks").select("source").distinct().select("source", X.path_category(s).alias("category"), X.basename(s).alias("name"))


@query("SELECT DISTINCT publisher AS raw, regexp_replace(lower(trim(publisher)), '^www\\.', '') AS publisher FROM chunks")
def publisher_norm(spark, d):
    return table(spark, d, "chunks").select(F.col("publisher").alias("raw")).distinct().select("raw", X.publisher_norm(F.col("raw")).alias("publisher"))


@query("""WITH p AS (SELECT publisher, list_filter(string_split(regexp_replace(regexp_replace(lower(trim(publisher)), '\\.example$', ''), '^www\\.', ''), '.'), lambda x: x <> '') AS l FROM publishers),
  s AS (SELECT publisher, l, CASE WHEN len(l) > 0 THEN l[-1] ELSE '' END AS tld, CASE WHEN len(l) > 1 THEN l[-2] WHEN len(l) > 0 THEN l[1] ELSE '' END AS sld FROM p)
  SELECT publisher, CASE WHEN sld IN ('mckinsey','bcg','bain','deloitte','pwc','kpmg','ey','accenture','gartner','forrester','idc','oliverwyman','rolandberger','kearney','strategyand','capgemini') THEN 'consultancy'
    WHEN sld IN ('worldbank','imf','oecd','un','wto','weforum','europa','iea','who','unctad') OR tld IN ('gov','mil','int') THEN 'government'
    WHEN tld = 'edu' OR list_contains(l, 'ac') THEN 'academic' WHEN tld = 'org' THEN 'association' WHEN tld IN ('com','net','io','ai','co','biz') THEN 'company' ELSE '' END AS source_type FROM s""")
def classify_source_type(spark, d):
    return table(spark, d, "publishers").select("publisher", X.classify_source_type(F.regexp_replace("publisher", r"\.example$", "")).alias("source_type"))


@query("SELECT doc_id, regexp_extract(coalesce(nullif(published_date, ''), title, ''), '(?:19|20)[0-9]{2}') AS year FROM documents")
def manifest_year(spark, d):
    return table(spark, d, "documents").select("doc_id", X.manifest_year(F.col("published_date"), F.col("title")).alias("year"))


@query("""WITH f AS (SELECT DISTINCT seq, list_transform(regexp_extract_all(answer, '\\$?[0-9][0-9.,]*%?'), lambda x: regexp_replace(x, '[.,]+$', '')) AS a FROM messages WHERE answer IS NOT NULL),
  u AS (SELECT DISTINCT seq, unnest(a) AS x FROM f)
  SELECT seq, string_agg(x, '|' ORDER BY length(x) DESC, x) AS anchors FROM u GROUP BY seq""")
def numeric_anchors(spark, d):
    m = table(spark, d, "messages").select("seq", "answer").distinct().filter("answer IS NOT NULL")
    return m.select("seq", F.array_join(X.numeric_anchors(F.col("answer")), "|").alias("anchors")).filter("anchors <> ''")


@query("""SELECT doc_id, trim(regexp_replace(CASE WHEN instr(text, 'market') > 0 THEN substr(text, greatest(1, instr(text, 'market') - 140), instr(text, 'market') + 140 - greatest(1, instr(text, 'market') - 140)) ELSE substr(text, 1, 280) END,
  '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS snippet FROM documents""")
def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), F.lit("market")).alias("snippet"))


@query("""WITH k AS (SELECT DISTINCT seq, list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: coalesce(try_cast(x AS BIGINT), 9223372036854775807)) AS l FROM messages WHERE answer IS NOT NULL)
  SELECT seq, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS markers FROM k""")
def cited_indices(spark, d):
    m = table(spark, d, "messages").select("seq", "answer").distinct().filter("answer IS NOT NULL")
    return m.select("seq", F.array_join(X.cited_indices(F.col("answer")).cast("array<string>"), ",").alias("markers"))


@query("WITH {LAST} SELECT conversation_id, string_agg('User: ' || coalesce(question, '') || chr(10) || 'Assistant: ' || coalesce(answer, ''), chr(10) ORDER BY seq) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS b FROM m) WHERE b <= 6 GROUP BY conversation_id")
def history_render(spark, d):
    return ingest.render_history(ingest.history(table(spark, d, "messages").select("seq", "conversation_id", "question", "answer").distinct(), 6))


@query("WITH {LAST} SELECT conversation_id, seq, b::INT AS back FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS b FROM m) WHERE b <= 6")
def history_last_n(spark, d):
    return ingest.history(table(spark, d, "messages").select("seq", "conversation_id", "question", "answer").distinct(), 6).select("conversation_id", "seq", "back")


@query("WITH {LAST} SELECT conversation_id, count(*) AS n_turns, max(seq) AS last_seq FROM m GROUP BY conversation_id")
def list_conversations(spark, d):
    return table(spark, d, "messages").select("seq", "conversation_id", "question", "answer").distinct().groupBy("conversation_id").agg(F.count("*").alias("n_turns"), F.max("seq").alias("last_seq"))


@query("""WITH h AS (SELECT DISTINCT seq, hit_rank, id, json_extract_string(metadata, '$.title') AS t FROM hits),
  n AS (SELECT seq, t, row_number() OVER (PARTITION BY seq ORDER BY hit_rank, id) AS i FROM h)
  SELECT seq, string_agg('[' || i || '] ' || coalesce(t, ''), chr(10) ORDER BY i) AS context FROM n GROUP BY seq""")
def numbered_context(spark, d):
    h = table(spark, d, "hits").select("seq", "hit_rank", "id", F.coalesce(F.get_json_object("metadata", "$.title"), F.lit("")).alias("t")).distinct()
    return h.groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("hit_rank", "id", "t"))), lambda x: x["t"]).alias("t")).select("seq", X.numbered_context(F.col("t")).alias("context"))


@query("""SELECT DISTINCT id, json_extract_string(metadata, '$.title') AS title, json_extract_string(metadata, '$.section') AS section, json_extract_string(metadata, '$.source_type') AS source_type,
  json_extract_string(metadata, '$.published_date') AS published_date, CAST(json_extract_string(metadata, '$.page') AS INT) AS page FROM chunks""")
def metadata_roundtrip(spark, d):
    kinds = "title string, section string, source_type string, published_date string, page int"
    return table(spark, d, "chunks").select("id", F.from_json("metadata", kinds).alias("m")).select("id", "m.*").distinct()


# ---------------------------------------------------------------- chunking



@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 200) / 180.0)::INT) * 180 + 1, 180)) AS st FROM w WHERE len(w) > 0),
  c AS (SELECT doc_id, (st / 180)::INT AS chunk_index, array_to_string(w[st + 1 : st + 200], ' ') AS text FROM s)
  SELECT doc_id, chunk_index, text, substr(sha256(text), 1, 16) AS content_hash FROM c""")
def chunk_text(spark, d):
    return chunking.chunk_text(table(spark, d, "documents"))


_LINES = """l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS a FROM documents)))"""
_S = _WS[:-1]  # a blank of any kind
_SECTIONS = f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}{_S}+[^\\t-\\r\\x1c-\\x20]') THEN 'h' WHEN regexp_matches(line, '[^' || '{_S[1:-1]}' || ']') THEN 'b' END AS kind FROM l),
  p AS (SELECT *, kind = 'h' AND last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'b' AS cut FROM k),
  n AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY doc_id ORDER BY i) AS block_no FROM p)
  SELECT doc_id, block_no::INT AS block_no, arg_max(regexp_extract(line, '^#{{1,6}}{_S}+(.*?){_S}*#*{_S}*$', 1), i) FILTER (kind = 'h') AS section, string_agg(line, chr(10) ORDER BY i) AS block FROM n GROUP BY doc_id, block_no"""
_MARKDOWN = f"""WITH {_LINES}, f AS (SELECT *, regexp_matches(line, '^{_S}*(```|~~~)') AS fence, regexp_matches(line, '^{_S}*\\|.*\\|{_S}*$') AS bar, count(*) FILTER (regexp_matches(line, '^{_S}*(```|~~~)')) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l),
  k AS (SELECT *, CASE WHEN n % 2 = 1 OR fence THEN (n + 1) // 2 END AS code FROM f),
  r AS (SELECT *, code IS NULL AND bar AS t, i - row_number() OVER (PARTITION BY doc_id, code IS NULL AND bar ORDER BY i) AS run FROM k),
  w AS (SELECT *, CASE WHEN code IS NOT NULL THEN 'c' || code WHEN t AND count(*) OVER (PARTITION BY doc_id, t, run) > 1 THEN 't' || run ELSE 'p' END AS kind FROM r),
  c AS (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM w), g AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM c),
  s AS (SELECT doc_id, seg, any_value(kind) <> 'p' AS atomic, string_agg(line, chr(10) ORDER BY i) AS block FROM g GROUP BY doc_id, seg),
  x AS (SELECT *, list_filter(string_split_regex(block, '{_WS}'), lambda x: x <> '') AS v FROM s),
  o AS (SELECT doc_id, seg, 0 AS st, block AS text FROM x WHERE atomic UNION ALL SELECT doc_id, seg, st, array_to_string(v[st + 1 : st + 200], ' ') FROM (SELECT doc_id, seg, v, unnest(range(0, greatest(0, ceil((len(v) - 200) / 180.0)::INT) * 180 + 1, 180)) AS st FROM x WHERE NOT atomic AND len(v) > 0))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg, st) - 1)::INT AS chunk_index, text FROM o"""


@query(_SECTIONS)
def split_sections(spark, d):
    return chunking.sections(table(spark, d, "documents"))


@query(_MARKDOWN)
def chunk_markdown(spark, d):
    return chunking.chunk_markdown(table(spark, d, "documents"))


@query()
def coalesce_small(spark, d):
    pieces = F.split(F.coalesce("text", F.lit("")), "\n\n")
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.coalesce_small(pieces, 400)).alias("piece_no", "piece"))


def _plans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_plans").groupBy("source").agg(F.max_by(F.struct("pages", "slots", "title", "content_hash", "size_bytes", "written", "failed"), "planned_at").alias("p")).select("source", "p.*")


@query()
def ingest_pages(spark, d):
    return chunking.ingest_pages(_plans(spark, d), least=400)


@query(r"""WITH p AS (SELECT source, arg_max(pages, planned_at) AS pages FROM doc_plans GROUP BY source), x AS (SELECT source, i - 1 AS page, pages[i] AS t FROM (SELECT source, pages, unnest(range(1, len(pages) + 1)) AS i FROM p) WHERE pages[i] IS NOT NULL),
  y AS (SELECT *, regexp_replace(lower(array_to_string(list_filter(string_split(t, chr(10)), lambda l, j: j % 3 <> 0), chr(10))), '[^a-z0-9]+', '', 'g') AS have FROM x),
  l AS (SELECT source, page, have, unnest(a) AS line, unnest(range(len(a))) AS pos FROM (SELECT *, string_split_regex(t, '\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS a FROM y)),
  k AS (SELECT *, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') AS key FROM l WHERE length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 10),
  h AS (SELECT source, key FROM k JOIN (SELECT source, count(DISTINCT page) AS n FROM x GROUP BY source) USING (source) GROUP BY source, key, n HAVING count(DISTINCT page) >= 3 AND count(DISTINCT page) >= 0.25 * n),
  w AS (SELECT source, page, key, min(pos) AS pos, arg_min(line, pos) AS line FROM k ANTI JOIN h USING (source, key) WHERE key <> '' AND NOT contains(have, key) GROUP BY source, page, key),
  r AS (SELECT source, page, string_agg(array_to_string(list_filter(string_split_regex(line, '{WS}'), lambda v: v <> ''), ' '), chr(10) ORDER BY pos) AS recovered FROM w GROUP BY source, page)
  SELECT source, page::INT AS page, coalesce(recovered, '') AS recovered FROM x LEFT JOIN r USING (source, page)""".replace("{WS}", _WS).replace("\\\\", "\\"))
def recover_dropped(spark, d):
    """The layout text is the page without every third line."""
    pages = _plans(spark, d).select("source", F.posexplode("pages").alias("page", "plain_text")).filter("plain_text IS NOT NULL")
    layout = F.array_join(F.filter(F.split("plain_text", "\n"), lambda x, i: i % 3 != 2), "\n")
    return ingest.recover_dropped(pages.withColumn("layout_text", layout))


@query()
def inject_figures(spark, d):
    plans = _plans(spark, d)
    results = plans.select(F.explode("slots.custom_id").alias("custom_id")).filter("custom_id IS NOT NULL").distinct().withColumn("text", F.concat(F.lit("Figure "), "custom_id"))
    return ingest.plan_to_pages(plans, results)


@query()
def greedy_pack(spark, d):
    rows = table(spark, d, "chunks").select("source", F.col("chunk_index").cast("bigint").alias("seq"), (F.length("text") + 512).alias("bytes")).distinct().filter("source IS NOT NULL AND bytes IS NOT NULL")
    return ingest.greedy_pack(rows, 4000, by="source")


# ---------------------------------------------------------------- search


@query("SELECT doc_id, round(CAST('0x' || substr(sha256(title), 1, 2) AS INT) / 255.0, 6) AS e1, round(CAST('0x' || substr(sha256(title), 3, 2) AS INT) / 255.0, 6) AS e2, round(CAST('0x' || substr(sha256(title), 15, 2) AS INT) / 255.0, 6) AS e8 FROM documents WHERE title IS NOT NULL")
def fake_embed(spark, d):
    v = search.fake_embed(F.col("title"), 8)
    return table(spark, d, "documents").filter("title IS NOT NULL").select("doc_id", *[F.round(F.element_at(v, i), 6).alias(f"e{i}") for i in (1, 2, 8)])


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", (F.round(search.cosine(F.col("x"), F.col("y")), 6) + 0.0).alias("cosine"))


@query("WITH {LIB}, {DENSE} SELECT id, score FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, round(list_cosine_similarity(emb, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) + 0.0 AS score FROM lib)) WHERE r <= 10")
def dense_topk(spark, d):
    q = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").head()["embedding"]
    return search.dense_topk(library(spark, d), list(q), 10)


@query("WITH {LIB}, {DENSE} SELECT query_id, id, score, rank::INT AS rank FROM dense WHERE rank <= 10")
def dense_topk_batch(spark, d):
    lib = library(spark, d)
    return search.dense_topk_batch(lib, asked(lib), 10)


@query("WITH {LIB}, {BM25} SELECT query_id, id, score, rank::INT AS rank FROM bm25 WHERE rank <= 10")
def bm25_topk(spark, d):
    lib = library(spark, d)
    return search.bm25_topk(lib, asked(lib), 10)


_RRF = """f AS (SELECT query_id, id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS rrf
    FROM (SELECT * FROM dense WHERE rank <= 50) a FULL JOIN (SELECT * FROM bm25 WHERE rank <= 50) b USING (query_id, id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM f)
  SELECT r.query_id, r.id, round(list_cosine_similarity(lib.emb, q.qemb), 6) + 0.0 AS score, rrf, r.rank::INT AS rank FROM r JOIN lib ON lib.id = r.id JOIN q ON q.query_id = r.query_id WHERE r.rank <= 10"""


@query("WITH {LIB}, {DENSE}, {BM25}, " + _RRF)
def hybrid_rrf(spark, d):
    lib = library(spark, d)
    return search.hybrid_rrf(lib, asked(lib), 10)


_FILTER = search.MetadataFilter(category="Finance", published_from="2015", published_to="2020")
_PASS = "category = 'Finance' AND ((published_date >= '2015' AND published_date <= '2020') OR published_date IS NULL OR published_date = '')"


@query("WITH {LIB}, ok AS (SELECT id FROM lib WHERE " + _PASS + "), all_dense AS (SELECT query_id, id, round(list_cosine_similarity(emb, qemb), 6) + 0.0 AS score FROM lib JOIN ok USING (id), q), dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM all_dense), " + _BM25.replace("FROM lex)", "FROM lex SEMI JOIN ok USING (id))") + ", " + _RRF)
def filtered_hybrid(spark, d):
    lib = library(spark, d)
    return search.hybrid_rrf(lib, asked(lib), 10, _FILTER)


@query("""WITH {LIB}, {DENSE}, {BM25},
  a AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM dense WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
  b AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM bm25 WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
  f AS (SELECT query_id, id, round(0.7::DOUBLE * coalesce(a.s, 0) + 0.3::DOUBLE * coalesce(b.s, 0), 6) AS score FROM a FULL JOIN b USING (query_id, id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
  SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 10""")
def hybrid_weighted(spark, d):
    lib = library(spark, d)
    return search.hybrid_weighted(lib, asked(lib), 10)


_PLANS = {"a": search.SearchPlan("semantic"), "b": search.SearchPlan("lexical", _FILTER)}


@query("WITH {LIB}, {DENSE}, {BM25}, g AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex SEMI JOIN (SELECT id FROM lib WHERE " + _PASS + ") USING (id)) "
       "SELECT query_id, id, score, rank::INT AS rank, 'cosine' AS score_kind, 'a' AS plan FROM dense WHERE rank <= 5 AND query_id % 40 = 0 UNION ALL SELECT query_id, id, score, rank::INT, 'bm25', 'b' FROM g WHERE rank <= 5 AND query_id % 40 <> 0")
def search_plan_mixed(spark, d):
    lib = library(spark, d)
    return search.search_plans(lib, asked(lib).withColumn("plan", F.when(F.col("query_id") % 40 == 0, "a").otherwise("b")), _PLANS, 5)


@query("WITH {LIB} SELECT id, category, published_date FROM lib WHERE " + _PASS + " AND contains(lower(publisher), 'insight')")
def metadata_filter(spark, d):
    f = search.MetadataFilter(publisher=" WWW.Insight", category="Finance", published_from="2015", published_to="2020")
    return library(spark, d).filter(f.predicate()).select("id", "category", "published_date")


@query("SELECT doc_id, published_date FROM documents WHERE (published_date >= '2016' AND published_date <= '2018') OR published_date IS NULL OR published_date = ''")
def date_range_undated(spark, d):
    f = search.MetadataFilter(published_from="2016", published_to="2018")
    return table(spark, d, "documents").filter(f.predicate()).select("doc_id", "published_date")


@query("""WITH {LIB}, {DENSE}, p AS (SELECT d.query_id, d.id, d.score, d.rank, length(lib.text) >= 200 AS ok FROM dense d JOIN lib USING (id) WHERE d.rank <= 60),
  n AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY query_id) AS n_long FROM p),
  r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM n WHERE ok OR n_long = 0)
  SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 10""")
def min_chars_overfetch(spark, d):
    lib = library(spark, d)
    hits = search.dense_topk_batch(lib, asked(lib), 60).join(lib.select("id", "text"), "id")
    return search.min_chars(hits, 200, 10).select("query_id", "id", "score", "rank")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").select(F.col("seq").alias("query_id"), F.col("hit_rank").alias("rank"), "id", "score", "score_kind", "metadata").distinct()


@query("SELECT DISTINCT seq AS query_id, hit_rank AS rank, id, score FROM hits WHERE NOT ((coalesce(score_kind, 'cosine') = 'cosine' AND score < 0.3) OR (coalesce(score_kind, 'cosine') = 'bm25' AND score < 8.0)) AND score IS NOT NULL")
def threshold_filter(spark, d):
    return search.threshold(_hits(spark, d), {"cosine": 0.3, "bm25": 8.0}).select("query_id", "rank", "id", "score").filter("score IS NOT NULL").distinct()


@query(f"""WITH c AS (SELECT DISTINCT id, text FROM chunks), m AS (SELECT DISTINCT seq, question FROM messages), h AS (SELECT DISTINCT seq, hit_rank, id FROM hits),
  s AS (SELECT h.seq AS query_id, h.id, h.hit_rank, list_distinct({_TERMS.format("question")}) AS q, {_TERMS.format("text")} AS t FROM h JOIN m USING (seq) JOIN c USING (id)),
  v AS (SELECT query_id, id, hit_rank, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t)) / len(q), 6) ELSE 0.0 END AS score FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_rank, id) AS rank FROM v)
  SELECT query_id, id, score, rank::INT AS rank FROM r WHERE rank <= 3""")
def rerank_overlap(spark, d):
    h = _hits(spark, d).select("query_id", "rank", "id").distinct()
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
    m = table(spark, d, "messages").select(F.col("seq").alias("query_id"), "question").distinct()
    c = table(spark, d, "chunks").select("id", "text").distinct()
    hits = h.join(m, "query_id").join(c, "id")
    return search.rerank(hits, search.overlap_score(F.col("question"), F.col("text")), 3).select("query_id", "id", "score", "rank")


_SESSION = """h AS (SELECT DISTINCT seq AS query_id, id, score, seq % 3 = 0 AND hit_rank <= 2 AS s FROM hits WHERE score IS NOT NULL)"""


@query(f"""WITH {_SESSION}, b AS (SELECT query_id, id, score, CASE WHEN s THEN 0 ELSE 1 END AS tier FROM h),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY tier, score DESC) AS n FROM b) WHERE n = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, id) AS rank FROM o) SELECT query_id, id, score, tier, rank::INT AS rank FROM r WHERE rank <= 4""")
def session_first_merge(spark, d):
    h = table(spark, d, "hits").filter("score IS NOT NULL").select(F.col("seq").alias("query_id"), "id", "score", ((F.col("seq") % 3 == 0) & (F.col("hit_rank") <= 2)).alias("s")).distinct()
    return search.session_first(h.filter("s").drop("s"), h.filter("NOT s").drop("s"), 4)


@query(f"""WITH {_SESSION}, few AS (SELECT query_id FROM h GROUP BY query_id HAVING count(*) FILTER (s) < 2),
  b AS (SELECT query_id, id, score, CASE WHEN s THEN 0 ELSE 1 END AS tier FROM h WHERE s OR query_id IN (SELECT query_id FROM few)),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY tier, score DESC) AS n FROM b) WHERE n = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, id) AS rank FROM o) SELECT query_id, id, score, tier, rank::INT AS rank FROM r WHERE rank <= 2""")
def gather(spark, d):
    h = table(spark, d, "hits").filter("score IS NOT NULL").select(F.col("seq").alias("query_id"), "id", "score", ((F.col("seq") % 3 == 0) & (F.col("hit_rank") <= 2)).alias("s")).distinct()
    return search.gather(h.filter("s").drop("s"), h.filter("NOT s").drop("s"), h.select("query_id").distinct(), 2)


@query("""WITH h AS (SELECT DISTINCT seq AS query_id, id, score, json_extract_string(metadata, '$.category') = 'Finance' AS ok FROM hits), f AS (SELECT DISTINCT query_id FROM h WHERE ok)
  SELECT query_id, id, score, false AS broadened FROM h WHERE ok UNION ALL SELECT query_id, id, score, true FROM h WHERE query_id NOT IN (SELECT query_id FROM f)""")
def broaden_on_empty(spark, d):
    h = table(spark, d, "hits").select(F.col("seq").alias("query_id"), "id", "score", F.get_json_object("metadata", "$.category").alias("c")).distinct()
    free = h.select("query_id", "id", "score").distinct()
    return search.broaden(h.filter("c = 'Finance'").select("query_id", "id", "score").distinct(), free, h.select("query_id").distinct())


@query("WITH {LIB}, s AS (SELECT id, round(list_cosine_similarity(emb, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) + 0.0 AS score FROM lib) SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM s) WHERE r <= 100000")
def rank_all(spark, d):
    q = table(spark, d, "embeddings").filter("vec_id = 1").select("embedding").head()["embedding"]
    return search.dense_topk(library(spark, d), list(q), 100_000)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every vector of the table, and those of the queries among them."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v, v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
  SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vectors_topk(spark, d):
    return search.dense_topk_batch(*_vectors(spark, d), 10)


@query()
def ivf_topk(spark, d):
    vectors, queries = _vectors(spark, d)
    return search.ivf_topk(vectors, queries, 10, search.kmeans_centers(vectors, 16), 13)


@query()
def ivf_recall(spark, d):
    """The share of the exact top 10 that ivf_topk finds, with its parameters."""
    exact = vectors_topk(spark, d).select("query_id", "id")
    found = ivf_topk(spark, d).select("query_id", "id").withColumn("hit", F.lit(1))
    return exact.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def _chunk_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "chunks").select("id", "source", "chunk_index", "text", F.get_json_object("metadata", "$.section").alias("section")).distinct()
    hits = _hits(spark, d).select("query_id", "id", "rank").distinct().join(chunks, "id")
    return hits, chunks


@query("""WITH c AS (SELECT DISTINCT id, source, chunk_index, text FROM chunks), h AS (SELECT DISTINCT seq, id FROM hits), x AS (SELECT h.seq AS query_id, h.id, c.source, c.chunk_index FROM h JOIN c USING (id)),
  w AS (SELECT x.query_id, x.id, x.chunk_index, n.chunk_index AS pos, n.text FROM x JOIN c n ON n.source = x.source AND n.chunk_index BETWEEN x.chunk_index - 1 AND x.chunk_index + 1)
  SELECT query_id, id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, min(pos)::INT AS first_index, max(pos)::INT AS last_index FROM w GROUP BY query_id, id""")
def neighbor_window(spark, d):
    hits, chunks = _chunk_hits(spark, d)
    return search.neighbour_window(hits.select("query_id", "id", "source", "chunk_index").distinct(), chunks, 1)


@query()
def neighbor_expand(spark, d):
    hits, chunks = _chunk_hits(spark, d)
    return search.expand(hits.drop("section"), chunks)


# ---------------------------------------------------------------- library keeping


@query("SELECT source, max(planned_at) AS planned_at, arg_max(content_hash, planned_at) AS content_hash FROM doc_plans GROUP BY source")
def upsert_latest(spark, d):
    p = table(spark, d, "doc_plans").select("source", "planned_at", "content_hash")
    return p.groupBy("source").agg(F.max("planned_at").alias("planned_at"), F.max_by("content_hash", "planned_at").alias("content_hash"))


@query("SELECT DISTINCT id, source FROM chunks WHERE source IS NULL OR source NOT IN (SELECT source FROM chunks WHERE chunk_index >= 8 AND source IS NOT NULL)")
def delete_by_source(spark, d):
    c = table(spark, d, "chunks").select("id", "source", "chunk_index")
    return ingest.delete_by(c.select("id", "source").distinct(), "source", c.filter("chunk_index >= 8").select("source")).select("id", "source")


@query("""WITH cur AS (SELECT source, arg_max(content_hash, planned_at) AS h FROM doc_plans GROUP BY source), known AS (SELECT source, min(content_hash) AS h FROM doc_plans WHERE size_bytes % 3 <> 0 GROUP BY source UNION ALL SELECT DISTINCT source, 'x' FROM chunks WHERE chunk_index = 9)
  SELECT source, CASE WHEN k.h IS NULL THEN 'new' WHEN c.h IS NULL THEN 'removed' WHEN c.h = k.h THEN 'unchanged' ELSE 'changed' END AS action FROM cur c FULL JOIN known k USING (source)""")
def ingest_delta(spark, d):
    p = table(spark, d, "doc_plans")
    known = p.filter("size_bytes % 3 <> 0").groupBy("source").agg(F.min("content_hash").alias("content_hash")).unionByName(table(spark, d, "chunks").filter("chunk_index = 9").select("source", F.lit("x").alias("content_hash")).distinct())
    return ingest.delta(p.groupBy("source").agg(F.max_by("content_hash", "planned_at").alias("content_hash")), known)


@query(r"""WITH f AS (SELECT 'd' || doc_id AS source, text, CASE WHEN text IS NULL THEN 'none' ELSE sha256(text) END AS h, doc_id % 3 = 0 AS fresh, doc_id % 5 = 0 AS old, len(list_filter(string_split_regex(coalesce(text, ''), '{WS}'), lambda x: x <> '')) AS n FROM documents),
  a AS (SELECT *, CASE WHEN NOT fresh AND NOT old THEN 'unchanged' WHEN text IS NULL THEN 'failed' WHEN fresh THEN 'new' ELSE 'changed' END AS action FROM f)
  SELECT source, action, CASE WHEN action IN ('new', 'changed') THEN CASE WHEN n = 0 THEN 0 ELSE greatest(0, ceil((n - 200) / 180.0)::INT) + 1 END WHEN fresh THEN 0 ELSE 1 END::BIGINT AS n_chunks, (NOT fresh AND NOT old) OR action IN ('new', 'changed') AS known FROM a""".replace("{WS}", _WS).replace("\\\\", "\\"))
def ingest_apply(spark, d):
    """Documents as files: those divisible by 3 are new, others divisible by 5 have another hash than the one known; each known file has one old chunk."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), "text", F.coalesce(F.sha2("text", 256), F.lit("none")).alias("content_hash"), (F.col("doc_id") % 3 == 0).alias("fresh"), (F.col("doc_id") % 5 == 0).alias("old"))
    known = docs.filter("NOT fresh")
    state = known.select("source", F.when(F.col("old"), "before").otherwise(F.col("content_hash")).alias("content_hash"))
    library = known.select("source", F.lit(0).alias("chunk_index"), F.lit("before").alias("text"))
    chunks, state, outcome = ingest.apply_changes(library, state, docs, lambda files: chunking.chunk_text(files, "source"))
    n = chunks.groupBy("source").agg(F.count("*").alias("n_chunks"))
    now = state.join(docs.select("source", "content_hash"), ["source", "content_hash"], "left_semi").select("source", F.lit(True).alias("known"))
    return outcome.join(n, "source", "left").join(now, "source", "left").select("source", "action", F.coalesce("n_chunks", F.lit(0).cast("bigint")).alias("n_chunks"), F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT DISTINCT id, coalesce(json_extract_string(metadata, '$.content_hash'), substr(sha256(text), 1, 16)) AS content_hash, coalesce(json_extract_string(metadata, '$.chunk_index'), chunk_index::VARCHAR) AS chunk_index, text AS own_text FROM chunks")
def chunk_metadata(spark, d):
    m = ingest.chunk_metadata(F.col("text"), F.col("chunk_index"), F.map_filter(F.from_json("metadata", "map<string,string>"), lambda _, v: v.isNotNull()))
    return table(spark, d, "chunks").select("id", m.alias("m")).select("id", *[F.element_at("m", k).alias(n) for k, n in (("content_hash", "content_hash"), ("chunk_index", "chunk_index"), ("text", "own_text"))]).distinct()


@query("SELECT doc_id, title FROM documents ORDER BY doc_id LIMIT 100")
def scan_limit(spark, d):
    return ingest.scan(table(spark, d, "documents").select("doc_id", "title"), 100, "doc_id")


@query("""WITH a AS (SELECT source, CASE WHEN bool_or(coalesce(written, false)) THEN 'unchanged' WHEN bool_or(coalesce(failed, false)) THEN 'changed' ELSE 'new' END AS action FROM doc_plans GROUP BY source),
  c AS (SELECT split_part(source, '/', 1) AS category FROM a WHERE action IN ('new', 'changed'))
  SELECT count(*) FILTER (action = 'new') AS n_new, count(*) FILTER (action = 'changed') AS n_changed, count(*) FILTER (action = 'unchanged') AS n_unchanged, count(*) FILTER (action = 'removed') AS n_removed,
    (SELECT '{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}' FROM (SELECT category, count(*) AS n FROM c GROUP BY 1)) AS chunks_by_category FROM a""")
def ingest_run_summary(spark, d):
    p = table(spark, d, "doc_plans").groupBy("source").agg(F.bool_or(F.coalesce("written", F.lit(False))).alias("w"), F.bool_or(F.coalesce("failed", F.lit(False))).alias("f"))
    actions = p.select("source", F.when(F.col("w"), "unchanged").when(F.col("f"), "changed").otherwise("new").alias("action"))
    return ingest.run_summary(actions, actions.select("source", X.path_category(F.col("source")).alias("category")))


@query()
def manifest_join(spark, d):
    rows = drift.records(table(spark, d, "manifest_files"), table(spark, d, "manifest_lines")).select("folder", "filename", F.col("domain").alias("publisher"), F.col("detected_year").alias("published_year"), "manifest_id", "line_no")
    files = _plans(spark, d).select("source", F.regexp_extract("source", r"^(.*)/[^/]*$", 1).alias("folder"))
    return ingest.manifest_join(files, rows)


@query("""WITH f AS (SELECT source, row_number() OVER (ORDER BY source) AS pos FROM (SELECT DISTINCT source FROM doc_plans)), r AS (SELECT display_name, row_number() OVER (ORDER BY publisher) AS pos, publisher, source_type FROM publishers),
  j AS (SELECT f.pos, f.source, r.source_type, r.publisher FROM f JOIN r ON r.pos = (f.pos - 1) % 200 + 1)
  SELECT pos, source, coalesce(nullif(trim(source_type), ''), 'General') AS category, regexp_replace(lower(trim(publisher)), '^www\\.', '') AS publisher FROM j""")
def positional_manifest(spark, d):
    w = Window.orderBy("source")
    f = table(spark, d, "doc_plans").select("source").distinct().withColumn("pos", F.row_number().over(w).cast("bigint"))
    r = table(spark, d, "publishers").withColumn("k", F.row_number().over(Window.orderBy("publisher"))).select("k", F.col("source_type").alias("category"), "publisher")
    rows = f.withColumn("k", ((F.col("pos") - 1) % 200 + 1).cast("int")).join(r, "k").select("pos", "category", "publisher")
    return ingest.positional(f, rows, {"category": "General"})


@query("SELECT source, len(pages) AS n_pages, coalesce(sum(length(p)), 0)::BIGINT AS n_chars, count(*) FILTER (length(coalesce(p, '')) < 20) AS n_empty FROM (SELECT source, pages, unnest(pages) AS p FROM (SELECT DISTINCT source, pages FROM doc_plans)) GROUP BY source, pages")
def page_stats(spark, d):
    p = table(spark, d, "doc_plans").select("source", "pages").distinct()
    size = F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
    return p.filter(F.size("pages") > 0).select("source", F.size("pages").cast("bigint").alias("n_pages"), size.alias("n_chars"), F.size(F.filter("pages", lambda x: F.length(F.coalesce(x, F.lit(""))) < 20)).cast("bigint").alias("n_empty"))


# ---------------------------------------------------------------- grounding


@query("""WITH h AS (SELECT seq, count(DISTINCT hit_rank) AS n FROM hits GROUP BY seq), m AS (SELECT DISTINCT seq, answer FROM messages WHERE answer IS NOT NULL),
  k AS (SELECT m.seq, coalesce(h.n, 0) AS n_hits, list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: coalesce(try_cast(x AS BIGINT), 9223372036854775807)) AS l FROM m LEFT JOIN h USING (seq)),
  b AS (SELECT seq, n_hits, list_filter(l, lambda x, i: list_position(l, x) = i AND (x < 1 OR x > n_hits)) AS bad FROM k)
  SELECT seq, n_hits, n_hits > 0 AND len(bad) = 0 AS grounded, CASE WHEN n_hits = 0 THEN 'no supporting context' WHEN len(bad) > 0 THEN 'citations outside context 1-' || n_hits || ': [' || array_to_string(bad, ', ') || ']' ELSE '' END AS reason FROM b""")
def grounding_gate(spark, d):
    return grounding.gate(_answers(spark, d)).select("seq", "n_hits", "grounded", "reason")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "hits").groupBy("seq").agg(F.countDistinct("hit_rank").alias("n_hits"))
    m = table(spark, d, "messages").select("seq", "answer").distinct().filter("answer IS NOT NULL")
    return m.join(n, "seq", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)).cast("bigint"))


_NOTED = """a AS (SELECT seq, answer, coalesce(n, 0) AS n_hits, list_filter(l, lambda x, i: list_position(l, x) = i AND (x < 1 OR x > coalesce(n, 0))) AS bad FROM (SELECT m.*, h.n, list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: coalesce(try_cast(x AS BIGINT), 9223372036854775807)) AS l
    FROM (SELECT DISTINCT seq, answer FROM messages WHERE answer IS NOT NULL) m LEFT JOIN (SELECT seq, count(DISTINCT hit_rank) AS n FROM hits GROUP BY seq) h USING (seq))),
  c AS (SELECT *, CASE WHEN len(bad) > 0 THEN answer || chr(10) || chr(10) || '_Note: ' || array_to_string(list_transform(bad, lambda x: '[' || x || ']'), ', ') || ' could not be matched to a retrieved source and may be unreliable._' ELSE answer END AS noted FROM a)"""


@query(f"WITH {_NOTED} SELECT seq, CASE WHEN n_hits = 0 THEN '{grounding.ABSTENTION.replace(chr(39), chr(39) * 2)}' ELSE noted END AS answer FROM c")
def answer_gate(spark, d):
    return grounding.answer_gate(_answers(spark, d).withColumn("retrieved", F.lit(True))).select("seq", "answer")


@query(f"""WITH {_NOTED}, t AS (SELECT seq, count(*) AS n, count(*) FILTER (x <> '') AS told FROM (SELECT DISTINCT h.seq, h.hit_rank, CASE WHEN h.seq % 7 = 0 THEN '' ELSE h.id END AS x FROM hits h) GROUP BY seq), g AS (SELECT c.seq, coalesce(t.n, 0) AS n, coalesce(told, 0) AS told, list_filter(l, lambda x: x < 1 OR x > coalesce(t.n, 0)) AS bad
    FROM (SELECT seq, list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: coalesce(try_cast(x AS BIGINT), 9223372036854775807)) AS l FROM c) c LEFT JOIN t USING (seq))
  SELECT seq, CASE WHEN n > 0 AND told = 0 THEN 'skipped' WHEN n = 0 THEN 'abstained' WHEN len(bad) > 0 THEN 'ungrounded' ELSE 'grounded' END AS verdict FROM g""")
def node_gate(spark, d):
    """A turn is a node, its hits its sources; those of every seventh turn have no text."""
    h = table(spark, d, "hits").select("seq", "hit_rank", F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("id")).alias("text")).distinct()
    sources = h.groupBy("seq").agg(F.collect_list(F.struct(F.col("hit_rank").cast("string").alias("source"), "text")).alias("sources"))
    return grounding.node_gate(_answers(spark, d).select("seq", F.col("answer").alias("summary")).join(sources, "seq", "left")).select("seq", "verdict")


@query(f"WITH {_NOTED} SELECT seq, noted AS answer FROM c")
def citation_caveat(spark, d):
    return _answers(spark, d).select("seq", grounding.caveat(F.col("answer"), F.col("n_hits")).alias("answer"))


@query("""WITH h AS (SELECT seq, count(DISTINCT hit_rank) AS n FROM hits GROUP BY seq), m AS (SELECT DISTINCT seq, answer FROM messages WHERE answer IS NOT NULL),
  k AS (SELECT seq, coalesce(n, 0) AS n, list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: coalesce(try_cast(x AS BIGINT), 9223372036854775807)) AS l FROM m LEFT JOIN h USING (seq))
  SELECT seq, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i AND (x < 1 OR x > n)), ',') AS invalid FROM k""")
def verify_citations(spark, d):
    return _answers(spark, d).select("seq", F.array_join(X.invalid_citations(F.col("answer"), F.col("n_hits")).cast("array<string>"), ",").alias("invalid"))


@query()
def renumber_citations(spark, d):
    """Marker n of an answer becomes the number of its hit's source within the turn; markers without hit go."""
    h = table(spark, d, "hits").select("seq", "hit_rank", F.get_json_object("metadata", "$.source").alias("s")).distinct()
    first = h.withColumn("g", F.dense_rank().over(Window.partitionBy("seq").orderBy("s")))
    g = first.groupBy("seq").agg(F.transform(F.sort_array(F.collect_set(F.struct("hit_rank", "g"))), lambda x: x["g"]).alias("mapping"))
    m = table(spark, d, "messages").select("seq", "answer").distinct().filter("answer IS NOT NULL").join(g, "seq", "left")
    return m.select("seq", X.renumber_udf("answer", F.coalesce("mapping", F.array().cast("array<int>"))).alias("answer"))


@query()
def merge_sources(spark, d):
    rows = table(spark, d, "hits").select("seq", "hit_rank", "id", F.get_json_object("metadata", "$.source").alias("label")).distinct().join(table(spark, d, "chunks").select("id", "text").distinct(), "id")
    return grounding.merge_sources(rows.select(F.col("seq").alias("run_id"), "label", F.col("hit_rank").alias("seq"), "text"))


@query("""WITH h AS (SELECT DISTINCT seq, hit_rank, json_extract_string(metadata, '$.source') AS source FROM hits) SELECT seq, source, row_number() OVER (PARTITION BY seq ORDER BY r, source)::INT AS position FROM (SELECT seq, source, min(hit_rank) AS r FROM h GROUP BY ALL)""")
def distinct_in_order(spark, d):
    h = table(spark, d, "hits").select("seq", "hit_rank", F.get_json_object("metadata", "$.source").alias("source")).groupBy("seq", "source").agg(F.min("hit_rank").alias("r"))
    return h.select("seq", "source", F.row_number().over(Window.partitionBy("seq").orderBy("r", "source")).alias("position"))


# ---------------------------------------------------------------- metrics


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Gold of a turn: hits of the category of its first hit."""
    h = table(spark, d, "hits").select(F.col("seq").alias("query_id"), F.col("hit_rank").alias("rank"), "id", F.get_json_object("metadata", "$.category").alias("c")).distinct()
    first = h.groupBy("query_id").agg(F.min_by("c", F.struct("rank", "id")).alias("want"))
    gold = h.join(first, "query_id").filter(F.col("c") == F.col("want")).select("query_id", "id")
    return evaluate.judged(h.select("query_id"), h.select("query_id", "id", "rank"), gold)


_JUDGED = """h AS (SELECT DISTINCT seq AS query_id, hit_rank AS rank, id, json_extract_string(metadata, '$.category') AS c FROM hits),
  f AS (SELECT query_id, c AS want FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS n FROM h) WHERE n = 1),
  gold AS (SELECT DISTINCT h.query_id, h.id FROM h JOIN f USING (query_id) WHERE c = want), ng AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
  j AS (SELECT h.query_id, h.rank, g.id IS NOT NULL AS g, coalesce(ng.n, 0) AS n FROM h LEFT JOIN gold g ON g.query_id = h.query_id AND g.id = h.id LEFT JOIN ng ON ng.query_id = h.query_id)"""


@query(f"""WITH {_JUDGED} SELECT query_id, round(CASE WHEN max(n) > 0 THEN count(*) FILTER (g AND rank <= 3) / max(n) ELSE 0.0 END, 6) AS recall, round(count(*) FILTER (g AND rank <= 3) / 3, 6) AS precision,
  count(*) FILTER (g AND rank <= 3) > 0 AS hit, round(coalesce(1.0::DOUBLE / min(rank) FILTER (g), 0), 6) AS reciprocal_rank FROM j GROUP BY query_id""")
def metrics_at_k(spark, d):
    return evaluate.metrics(_judged(spark, d), 3)


@query(f"""WITH {_JUDGED}, p AS (SELECT query_id, {", ".join(f"CASE WHEN max(n) > 0 THEN count(*) FILTER (g AND rank <= {k}) / max(n) ELSE 0.0 END AS r{k}" for k in (1, 3, 5))},
  CASE WHEN count(*) FILTER (g AND rank <= 1) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h1, coalesce(1.0::DOUBLE / min(rank) FILTER (g), 0) AS rr FROM j GROUP BY query_id)
  SELECT count(*) AS n_queries, round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(h1), 6) AS hit_at_1, round(avg(rr), 6) AS mrr FROM p""")
def retrieval_summary(spark, d):
    return evaluate.retrieval_summary(_judged(spark, d))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, min(value) AS low, max(value) AS high, round(1000.0::DOUBLE / avg(value), 6) AS per_second FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_summary(spark, d):
    return evaluate.latency_summary(table(spark, d, "events"), "value", "event_type")


@query("WITH v AS (SELECT DISTINCT seq, grounded, abstention, len(coalesce(invalid_citations, [])) AS n FROM verdicts) SELECT seq AS query_id, CASE WHEN n > 0 AND coalesce(abstention IS NOT NULL, false) THEN 'stale_flag' WHEN n > 0 THEN 'resolved' WHEN abstention IS NOT NULL THEN 'known_gap' ELSE 'rot' END AS state FROM v")
def gold_triage(spark, d):
    v = table(spark, d, "verdicts").select("seq", "grounded", "abstention", F.coalesce(F.size("invalid_citations"), F.lit(0)).alias("n")).distinct()
    return evaluate.gold_triage(v.select(F.col("seq").alias("query_id"), F.greatest("n", F.lit(0)).alias("n_gold"), F.col("abstention").isNotNull().alias("expected_missing")))


@query("""WITH v AS (SELECT DISTINCT seq, grounded, reason, abstention IS NULL AS c, length(coalesce(reason, '')) % 5 + 1 AS s FROM verdicts)
  SELECT grounded, count(*) AS n, round(avg(s), 6) AS correctness, round(avg(6 - s), 6) AS groundedness, round(avg(CASE WHEN s >= 4 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(CASE WHEN c THEN s END), 6) AS correctness_with_context FROM v GROUP BY grounded""")
def judge_summary(spark, d):
    s = F.length(F.coalesce("reason", F.lit(""))) % 5 + 1
    v = table(spark, d, "verdicts").select("seq", "grounded", "reason", F.col("abstention").isNull().alias("context_sufficient"), s.alias("correctness")).distinct()
    return evaluate.judge_summary(v.withColumn("groundedness", 6 - F.col("correctness")), 4, "grounded")


@query("""WITH c AS (SELECT conversation_id, count(DISTINCT seq) AS n FROM messages GROUP BY 1), r AS (SELECT CASE WHEN n > 3 THEN 'complex' ELSE 'simple' END AS expected_tier, CASE WHEN n > 4 THEN 'complex' ELSE 'simple' END AS tier, n AS n_nodes FROM c)
  SELECT expected_tier, count(*) AS n, round(avg(CASE WHEN tier = expected_tier THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(n_nodes), 6) AS mean_nodes, max(n_nodes) AS most_nodes FROM r GROUP BY expected_tier""")
def routing_summary(spark, d):
    n = table(spark, d, "messages").groupBy("conversation_id").agg(F.countDistinct("seq").alias("n_nodes"))
    tier = lambda k: F.when(F.col("n_nodes") > k, "complex").otherwise("simple")
    return evaluate.routing_summary(n.select(tier(3).alias("expected_tier"), tier(4).alias("tier"), "n_nodes"))


@query("SELECT DISTINCT p.publisher AS query_id, d.doc_id AS id FROM documents d JOIN publishers p ON contains(regexp_replace(lower(d.text), '\\s+', '', 'g'), regexp_replace(lower(p.display_name), '\\s+', '', 'g')) OR contains(regexp_replace(lower(d.text), '\\s+', '', 'g'), lower(p.publisher))")
def resolve_gold(spark, d):
    q = table(spark, d, "publishers").select(F.col("publisher").alias("query_id"), F.array("display_name", "publisher").alias("needles"))
    return evaluate.resolve_gold(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), q)


@query("SELECT DISTINCT d.doc_id, p.publisher FROM documents d JOIN publishers p ON contains(regexp_replace(lower(d.text), '\\s+', '', 'g'), regexp_replace(lower(p.display_name), '\\s+', '', 'g'))")
def needle_match(spark, d):
    """Every publisher's name in every text: the needles are the bounded reference list (200 rows), broadcast as such."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    needles = F.broadcast(table(spark, d, "publishers").select("publisher", flat(F.col("display_name")).alias("needle")))
    docs = table(spark, d, "documents").select("doc_id", flat(F.col("text")).alias("hay"))
    return docs.join(needles, F.contains("hay", "needle")).select("doc_id", "publisher").distinct()


@query()
def needle_match_exact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.normalize_needle_udf(F.col("text")).alias("hay"))
    needles = table(spark, d, "publishers").select("publisher", X.normalize_needle_udf(F.col("display_name")).alias("needle"))
    return docs.join(F.broadcast(needles), F.contains("hay", "needle")).select("doc_id", "publisher").distinct()


@query()
def synthesize_concat(spark, d):
    """A run per conversation, its turns as nodes, their hits' sources as sources."""
    m = table(spark, d, "messages").select(F.col("conversation_id").alias("run_id"), "seq", F.col("answer").alias("summary")).distinct()
    h = table(spark, d, "hits").select("seq", F.col("hit_rank").alias("local"), F.get_json_object("metadata", "$.source").alias("label")).distinct().dropDuplicates(["seq", "local"])
    nodes = m.select("run_id", F.col("seq").cast("string").alias("node_id"), F.col("seq").alias("position"), "summary")
    sources = h.join(m.select("run_id", "seq"), "seq").select("run_id", F.col("seq").cast("string").alias("node_id"), "local", "label")
    return grounding.synthesize(nodes, sources)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'semantic' WHEN doc_id % 4 = 1 THEN 'hybrid_weighted' ELSE 'hybrid_rrf' END AS strategy, CASE WHEN doc_id % 4 < 3 THEN category END AS category, CASE WHEN doc_id % 4 = 1 THEN 0.6 END AS dense_weight FROM documents""")
def parse_plan(spark, d):
    made = F.to_json(F.struct(F.when(F.col("doc_id") % 4 == 0, "semantic").when(F.col("doc_id") % 4 == 1, "hybrid_weighted").otherwise("magic").alias("strategy"), F.struct(F.col("category"), F.lit(" ").alias("publisher")).alias("filter"), F.array(F.lit(0.6), F.lit(0.4)).alias("weights")))
    said = F.when(F.col("doc_id") % 4 == 3, F.lit("no plan } here {")).otherwise(F.concat(F.lit("Sure, here it is:\n```json\n"), made, F.lit("\n```")))
    p = search.parse_plan(said)
    return table(spark, d, "documents").select("doc_id", p["strategy"].alias("strategy"), p["category"].alias("category"), F.element_at(p["weights"], 1).alias("dense_weight"))


@query(f"""WITH {{LIB}}, {{DENSE}}, p AS (SELECT d.*, length(lib.text) >= 200 AS ok, lib.text FROM dense d JOIN lib USING (id) WHERE d.rank <= 180), n AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY query_id) AS n_long FROM p),
  r AS (SELECT query_id, id, text, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM n WHERE ok OR n_long = 0), t AS (SELECT * FROM r WHERE rank <= 30 AND score >= 0),
  s AS (SELECT t.query_id, id, rank, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0.0 END AS score FROM (SELECT t.*, list_distinct({_TERMS.format("query")}) AS a, {_TERMS.format("text")} AS b FROM t JOIN q USING (query_id)) t),
  o AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM s) SELECT query_id, id, score, rank::INT AS rank FROM o WHERE rank <= 8""")
def retrieve_corpus(spark, d):
    lib = library(spark, d)
    return search.retrieve_corpus(lib, asked(lib), search.SearchPlan("semantic"), 8, reranker=search.overlap_score).select("query_id", "id", "score", "rank")


# ---------------------------------------------------------------- tasks, namespaces, plans


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    name = F.when(e == "signup", "enqueued").when(e == "click", "claimed").when(e == "purchase", "acked").otherwise(e)
    # A task is what a user does on a day.
    return table(spark, d, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("task_id"), "ts", name.alias("event"))


@query("WITH {TASKS} SELECT task_id, state, attempts, last_ts FROM state")
def task_state(spark, d):
    return agents.task_state(_log(spark, d))


@query("WITH {TASKS} SELECT task_id, attempts FROM state WHERE state = 'inflight' AND last_ts <= (SELECT max(ts) FROM ev) - INTERVAL 5 SECOND")
def reclaimable(spark, d):
    """What is idle when the log ends."""
    ev = _log(spark, d)
    return agents.reclaimable(agents.task_state(ev).crossJoin(ev.agg(F.max("ts").alias("now"))), F.col("now")).select("task_id", "attempts")


@query("WITH {TASKS} SELECT task_id, 'worker-2' AS consumer, attempts + 1 AS attempts FROM state WHERE state = 'inflight' AND last_ts <= (SELECT max(ts) FROM ev) - INTERVAL 5 SECOND")
def reclaim(spark, d):
    ev = _log(spark, d)
    return agents.reclaim(agents.task_state(ev).crossJoin(ev.agg(F.max("ts").alias("now"))), F.col("now"), "worker-2")


@query("WITH {TASKS} SELECT task_id, attempts FROM state WHERE state = 'dead'")
def dead_letter(spark, d):
    return agents.task_state(_log(spark, d)).filter("state = 'dead'").select("task_id", "attempts")


@query("WITH {TASKS} SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'inflight') AS inflight, count(*) FILTER (state = 'dead') AS dead, count(*) FILTER (state = 'done') AS done FROM state")
def queue_stats(spark, d):
    return agents.queue_stats(agents.task_state(_log(spark, d)))


@query("SELECT DISTINCT seq AS task_id FROM messages WHERE seq NOT IN (SELECT seq FROM verdicts)")
def memo_skip(spark, d):
    return agents.memo_skip(table(spark, d, "messages").select(F.col("seq").alias("task_id")).distinct(), table(spark, d, "verdicts").select(F.col("seq").alias("task_id")))


@query("""SELECT DISTINCT seq, substr(sha256('{"capability": "answer", "inputs": {}, "node_id": "n' || seq || '", "run_id": "' || conversation_id || '"}'), 1, 16) AS key FROM messages""")
def idempotency_key(spark, d):
    m = table(spark, d, "messages").select("seq", "conversation_id").distinct()
    return m.select("seq", agents.idempotency_key(F.col("conversation_id"), F.concat(F.lit("n"), F.col("seq").cast("string")), F.lit("answer"), F.lit("{}")).alias("key"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS expires, count(*) AS n FROM s GROUP BY user_id, s.n""")
def ttl_sessions(spark, d):
    return agents.ttl_sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")


@query()
def schedule_due(spark, d):
    return agents.schedule_due(table(spark, d, "events"), "event_type", "ts", 60)


def _dag(spark: SparkSession, d: str) -> DataFrame:
    """A plan per conversation: each turn depends on the one before, every third on the one before that, too."""
    m = table(spark, d, "messages").select("conversation_id", "seq").distinct()
    w = Window.partitionBy("conversation_id").orderBy("seq")
    m = m.select(F.col("conversation_id").alias("run_id"), "seq", F.lag("seq").over(w).alias("p1"), F.lag("seq", 2).over(w).alias("p2"))
    dep = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    return m.select("run_id", dep("seq").alias("node_id"), F.array_compact(F.array(F.when(F.col("seq") % 4 != 0, dep("p1")), F.when(F.col("seq") % 3 == 0, dep("p2")))).alias("depends_on"))


_DAG = """m AS (SELECT DISTINCT conversation_id, seq FROM messages), e AS (SELECT conversation_id AS run_id, seq, CASE WHEN seq % 4 <> 0 THEN lag(seq) OVER w END AS p1, CASE WHEN seq % 3 = 0 THEN lag(seq, 2) OVER w END AS p2 FROM m WINDOW w AS (PARTITION BY conversation_id ORDER BY seq)),
  edges AS (SELECT run_id, seq, p1 AS p FROM e WHERE p1 IS NOT NULL UNION SELECT run_id, seq, p2 FROM e WHERE p2 IS NOT NULL),
  waves AS (SELECT run_id, seq, 0 AS wave FROM e WHERE p1 IS NULL AND p2 IS NULL UNION SELECT edges.run_id, edges.seq, wave + 1 FROM waves JOIN edges ON edges.run_id = waves.run_id AND edges.p = waves.seq)"""


@query(f"WITH RECURSIVE {_DAG} SELECT run_id, 'n' || seq AS node_id, max(wave)::INT AS wave FROM waves GROUP BY ALL")
def dag_waves(spark, d):
    return agents.dag_waves(_dag(spark, d))


def _partly_broken(spark: SparkSession, d: str) -> DataFrame:
    """Plans of which those with a turn divisible by 11 depend on a node that isn't there, and those with one divisible by 13 are cycles."""
    dag, n = _dag(spark, d), F.substring("node_id", 2, 20).cast("bigint")
    return dag.withColumn("depends_on", F.when(n % 11 == 0, F.array_append("depends_on", "elsewhere")).when(n % 13 == 0, F.array_append("depends_on", F.col("node_id"))).otherwise(F.col("depends_on")))


_BROKEN = "bool_and(seq % 11 <> 0 AND seq % 13 <> 0)"


@query(f"SELECT conversation_id AS run_id, count(DISTINCT seq) AS n_nodes, {_BROKEN} AS valid FROM messages GROUP BY 1")
def dag_valid(spark, d):
    return agents.dag_valid(_partly_broken(spark, d))


@query(f"WITH v AS (SELECT conversation_id AS run_id, {_BROKEN} AS valid FROM messages GROUP BY 1) SELECT run_id, 'answer' AS node_id FROM v WHERE NOT valid UNION ALL SELECT DISTINCT conversation_id, 'n' || seq FROM messages JOIN v ON run_id = conversation_id WHERE valid")
def planned(spark, d):
    return agents.planned(_partly_broken(spark, d)).select("run_id", "node_id")


@query("WITH m AS (SELECT DISTINCT conversation_id, seq FROM messages) SELECT conversation_id AS run_id, seq AS position, 'n' || seq AS node_id, CASE WHEN seq IN (SELECT seq FROM verdicts) THEN 'done' ELSE 'failed' END AS status FROM m")
def plan_status(spark, d):
    node = F.concat(F.lit("n"), F.col("seq").cast("string")).alias("node_id")
    m = table(spark, d, "messages").select(F.col("conversation_id").alias("run_id"), F.col("seq").alias("position"), node).distinct()
    r = table(spark, d, "messages").select("seq", "conversation_id").distinct().join(table(spark, d, "verdicts").select("seq").distinct(), "seq").select(F.col("conversation_id").alias("run_id"), node)
    return agents.plan_status(m, r)


@query("""WITH {TASKS}, l AS (SELECT task_id AS run_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS latest FROM ev GROUP BY 1), r AS (SELECT task_id AS run_id, count(*) AS n_results FROM ev WHERE event = 'acked' GROUP BY 1)
  SELECT run_id, n_events, first_ts, latest AS last_ts, coalesce(n_results, 0) AS n_results, state FROM l LEFT JOIN r USING (run_id) LEFT JOIN state ON task_id = run_id""")
def run_view(spark, d):
    ev = _log(spark, d)
    runs = ev.withColumnRenamed("task_id", "run_id")
    return agents.run_view(runs, runs.filter("event = 'acked'").select("run_id"), agents.task_state(ev))


@query("SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq, ts, event_type AS event FROM events")
def run_ledger(spark, d):
    return agents.ledger(table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("event_type").alias("event")))
