"""Scalar functions over text and metadata: column in, column out, all inside the JVM unless named `*_udf`."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: every character that separates words, as Unicode has them.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


# Fixed value: what ends a line.
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def words(text: Column) -> Column:
    """The words between white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda x: x != "")


def terms(text: Column) -> Column:
    """Search terms: lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    """The same on every retry, unlike a random id."""
    return F.substring(F.sha2(F.concat_ws("\u0001", source, index.cast("string"), text), 256), 1, 32)


def dedup_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def path_category(source: Column) -> Column:
    """The first folder of a path, `uncategorized` for files at the root."""
    parts = F.split(source, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("uncategorized")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def publisher_norm(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(domain)), r"^www\.", "")


# Names of organisations by kind.
CONSULTANCIES = (
    "mckinsey", "bcg", "bain", "deloitte", "pwc", "kpmg", "ey", "accenture", "gartner", "forrester", "idc", "oliverwyman",
    "rolandberger", "kearney", "strategyand", "capgemini",
)
INTERGOVERNMENTAL = ("worldbank", "imf", "oecd", "un", "wto", "weforum", "europa", "iea", "who", "unctad")


def classify_source_type(domain: Column) -> Column:
    """The kind of a publisher by its host; the order of the cases matters."""
    labels = F.filter(F.split(publisher_norm(domain), r"\."), lambda x: x != "")
    n = F.size(labels)
    tld = F.when(n > 0, F.element_at(labels, -1)).otherwise("")
    sld = F.when(n > 1, F.get(labels, n - 2)).when(n > 0, F.get(labels, F.lit(0))).otherwise("")
    return (
        F.when(sld.isin(*CONSULTANCIES), "consultancy")
        .when(sld.isin(*INTERGOVERNMENTAL) | tld.isin("gov", "mil", "int"), "government")
        .when((tld == "edu") | F.array_contains(labels, "ac"), "academic")
        .when(tld == "org", "association")
        .when(tld.isin("com", "net", "io", "ai", "co", "biz"), "company")
        .otherwise("")
    )


def manifest_year(detected: Column, score: Column) -> Column:
    """The first four-digit year of what was detected, or of the score where nothing was; empty if that has none."""
    return F.regexp_extract(F.coalesce(F.nullif(detected, F.lit("")), score, F.lit("")), r"(?:19|20)\d{2}", 0)


def citation_source(*candidates: Column) -> Column:
    """The first of the candidates that says something."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def numeric_anchors(text: Column) -> Column:
    """The distinct numbers of a text, longest first, then by their text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\$?\d[\d.,]*%?)"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]+$", ""))
    keyed = F.transform(F.array_distinct(found), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def snippet(text: Column, anchor: Column, around: int = 140, plain: int = 280) -> Column:
    """The text around the first occurrence of the anchor with white space collapsed; without it the beginning."""
    at = F.position(anchor, text)
    start = F.greatest(F.lit(1), at - around)
    near = F.substring(text, start, at + around - start)
    return F.trim(F.regexp_replace(F.when(at > 0, near).otherwise(F.substring(text, 1, plain)), WS, " "))


def cited_indices(answer: Column) -> Column:
    """The distinct numbers of `[n]` markers in the order they are first seen; those beyond a bigint are the largest one."""
    most = F.lit(2**63 - 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("bigint"), most)))


def invalid_citations(answer: Column, n_hits: Column) -> Column:
    return F.filter(cited_indices(answer), lambda x: (x < 1) | (x > n_hits))


def numbered_context(texts: Column) -> Column:
    """`[i] text` lines; what to say if there are none."""
    return F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")).otherwise("(no relevant context found)")


def email_norm(email: Column) -> Column:
    return F.lower(F.trim(email))


_FOLDS = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", "‐": "-", "‑": "-"})


def normalize_needle(text: str | None) -> str:
    """Compatibility forms, entities, quotes and dashes folded, case folded, broken words joined, no white space."""
    s = html.unescape(unicodedata.normalize("NFKC", text or "")).translate(_FOLDS).casefold()
    return "".join(re.sub(r"-\s*\n\s*", "", s).split())


@F.pandas_udf(StringType())
def normalize_needle_udf(text: pd.Series) -> pd.Series:
    return text.map(normalize_needle)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


_BEFORE_MARK = re.compile(r"[ \t]+([,.;:!?])")
_LINE_END = re.compile(r"[ \t]+$", re.MULTILINE)


def renumber(answer: str | None, mapping: dict[int, int]) -> str | None:
    """Local markers become global ones; markers that can't be resolved go; blanks are single, none before marks or at line ends."""
    if answer is None:
        return None
    out = re.sub(r"\[(\d+)\]", lambda m: f"[{mapping[int(m[1])]}]" if int(m[1]) in mapping else "", answer)
    return _LINE_END.sub("", _BEFORE_MARK.sub(r"\1", re.sub(r"[ \t]{2,}", " ", out)))


@F.pandas_udf(StringType())
def renumber_udf(answer: pd.Series, mapping: pd.Series) -> pd.Series:
    """mapping: an array whose i-th element is the global number of local marker i, null if there is none."""
    return pd.Series([renumber(a, {i + 1: int(g) for i, g in enumerate(m if m is not None else ()) if g is not None and g == g}) for a, m in zip(answer, mapping)])
