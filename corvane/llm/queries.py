"""The queries of this subpackage: name -> (SparkSession, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import encoding, harm, packing, pairs, repeated_lines, scan_noise, splitting
from corvane.llm.items import items
from corvane.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "chunks"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.cleaned(table(spark, d, "chunks"))


def p2_merges(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.incremental(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.find_noise(table(spark, d, "doc_plans"), table(spark, d, "chunks"))


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.reflowed(table(spark, d, "doc_plans"), table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.bad_pairs(table(spark, d, "messages"), table(spark, d, "verdicts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(items(table(spark, d, "doc_plans"), table(spark, d, "chunks")))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(items(table(spark, d, "doc_plans"), table(spark, d, "chunks")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack_documents(table(spark, d, "documents")))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return harm.score_documents(table(spark, d, "documents"), table(spark, d, "labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return harm.found(_scores(spark, d))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).drop("source")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return harm.rates(_scores(spark, d))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_clean, p2_merges, p3_found, p3_text, p4_found, p5_found, p5_pieces, p6_ids, p7_containers, p7_fill, p8_found, p8_scores, p8_rates)}

_MONTHS = "|".join(sorted(set(repeated_lines._MONTHS), key=lambda m: (-len(m), m)))

_P2 = f"""WITH c AS (SELECT DISTINCT id, source, text, nullif(regexp_replace(lower(trim(publisher)), '^www\\.', ''), '') AS p FROM chunks WHERE source IS NOT NULL),
        s AS (SELECT source, max(p) AS site FROM c GROUP BY source HAVING max(p) IS NOT NULL), n AS (SELECT site, count(*) AS docs FROM s GROUP BY site),
        l AS (SELECT id, source, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT id, source, string_split(coalesce(text, ''), chr(10)) AS a FROM c)),
        k AS (SELECT id, site, source, CAST(line_no AS INTEGER) AS line_no, regexp_replace(regexp_replace(regexp_replace(lower(line), '&[a-z]+;', ' ', 'g'), '\\b({_MONTHS})\\b', '', 'g'), '[^\\p{{L}}]', '', 'g') AS key FROM l JOIN s USING (source)),
        r AS (SELECT site, key FROM k JOIN n USING (site) WHERE key <> '' GROUP BY site, key, docs HAVING count(DISTINCT source) >= 5 AND count(DISTINCT source) * 5 >= docs)"""

ORACLES: dict[str, str] = {
    "p2_found": f"{_P2} SELECT DISTINCT id, line_no FROM k JOIN r USING (site, key)",
    "p2_clean": f"""{_P2}, x AS (SELECT DISTINCT id, line_no FROM k JOIN r USING (site, key)), d AS (SELECT DISTINCT id, text FROM chunks), y AS (SELECT id, list(line_no) AS gone FROM x GROUP BY id)
        SELECT id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda t, i: NOT list_contains(gone, i)), chr(10)) END AS text, coalesce(len(gone), 0)::INT AS n_removed FROM d LEFT JOIN y USING (id)""",
    "p5_found": """
        SELECT DISTINCT 'page' AS item_type, source AS item, CAST(i AS INTEGER) AS page_no
        FROM doc_plans, unnest(range(1, len(pages) + 1)) AS t(i) WHERE length(pages[i]) > 2400
        UNION SELECT DISTINCT 'chunk', id, 0 FROM chunks WHERE length(text) > 2400
    """,
}
