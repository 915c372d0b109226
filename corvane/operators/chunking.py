"""Documents into chunks: words with overlap, Markdown sections, atomic blocks, coalescing, pages.

Blocks of Markdown are found in the kinds of its lines: a text's lines are written as a word with one letter per line,
and a pattern over that word tells where blocks begin and end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import content_hash, words

SIZE, OVERLAP = 200, 20

# What a heading, a table row and a fence look like.
_HEADING = re.compile(r"#{1,6}\s+(\S.*?)\s*#*\s*")
_ROW = re.compile(r"\s*\|.*\|\s*")
_FENCE = re.compile(r"\s*(?:```|~~~)")


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and less than size")


def _starts(n: Column, size: int, overlap: int) -> Column:
    """Where the chunks of `n` words begin: the last one is the first that reaches the end, so no tail is repeated."""
    step = size - overlap
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int")) * step, F.lit(step))


def chunk_text(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, text, content_hash): `size` words each, the next `size - overlap` words later; blank text gives none.

    The words are split once, below the explode that only adds a start; no shuffle.
    """
    _check(size, overlap)
    split = documents.select(key, words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = split.select(key, "w", F.posexplode(_starts(F.size("w"), size, overlap)).alias("chunk_index", "start"))
    return starts.select(key, "chunk_index", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text")).withColumn("content_hash", content_hash(F.col("text")))


def blocks(text: str, carried: str | None = None) -> list[tuple[str | None, str]]:
    """(section, block): a block begins at every heading that follows body text; its section is its last heading, else the carried one.

    Headings in a row are one block with the body below them.
    """
    lines = text.splitlines()
    heads = [_HEADING.fullmatch(x) for x in lines]
    kinds = "".join("h" if m else "b" if x.strip() else "-" for x, m in zip(lines, heads))
    cuts = [0, *(m.end() for m in re.finditer(r"b-*(?=h)", kinds)), len(lines)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            at = kinds.rfind("h", a, b)
            carried = heads[at][1] if at >= 0 else carried
            out.append((carried, "\n".join(lines[a:b])))
    return out


def segments(text: str) -> list[tuple[bool, str]]:
    """(atomic, block): fenced blocks, from a fence to the next or the end, and tables of at least two rows are atomic; the rest is prose."""
    lines = text.splitlines()
    kinds = "".join("f" if _FENCE.match(x) else "r" if _ROW.fullmatch(x) else "p" for x in lines)
    found = re.finditer(r"(f[^f]*f?|rr+)|(?:p|(?<!r)r(?!r))+", kinds)
    return [(bool(m[1]), "\n".join(lines[m.start() : m.end()])) for m in found]


def pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Atomic blocks whole even if oversized, prose by words."""
    step, out = size - overlap, []
    for atomic, block in segments(text):
        w = block.split()
        out += [block] if atomic else [" ".join(w[i : i + size]) for i in range(0, max(len(w) - overlap, min(1, len(w))), step)]
    return out


def coalesce_small(pieces: Column, least: int) -> Column:
    """Neighbouring pieces below `least` characters are joined until they reach it; others pass untouched. A native fold."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("run"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["run"].isNull(), p).otherwise(F.concat(acc["run"], F.lit("\n\n"), p))
        flushed = F.when(acc["run"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["run"]))
        none = F.lit(None).cast("string")
        return (
            F.when(F.length(p) >= least, F.struct(F.array_append(flushed, p).alias("out"), none.alias("run")))
            .when(F.length(joined) >= least, F.struct(F.array_append(acc["out"], joined).alias("out"), none.alias("run")))
            .otherwise(F.struct(acc["out"].alias("out"), F.nullif(joined, F.lit("")).alias("run")))
        )

    return F.aggregate(pieces, zero, step, lambda acc: F.when(acc["run"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["run"])))


def ingest_pages(plans: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = 0) -> DataFrame:
    """(source, chunk_index, page, section, text) of (source, pages): sections are carried across a document's pages.

    One row holds one document, so nothing is shuffled: Python finds the pieces of each block, the JVM coalesces and
    numbers them. Null pages are empty; a document of one page has no page numbers.
    """
    _check(size, overlap)

    def found(pages: list) -> list[dict]:
        out, carried = [], None
        for page, text in enumerate(pages, 1):
            for carried, block in blocks(text or "", carried):
                out.append({"page": page if len(pages) > 1 else None, "section": carried, "pieces": pieces(block, size, overlap)})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"source": df["source"], "blocks": [found(list(p) if p is not None else []) for p in df["pages"]]})

    rows = plans.select("source", "pages").mapInPandas(run, "source string, blocks array<struct<page:int,section:string,pieces:array<string>>>")
    chunks = F.flatten(F.transform("blocks", lambda b: F.transform(coalesce_small(b["pieces"], least), lambda t: F.struct(b["page"].alias("page"), b["section"].alias("section"), t.alias("text")))))
    return rows.select("source", F.posexplode(chunks).alias("chunk_index", "c")).select("source", "chunk_index", "c.page", "c.section", "c.text")


def _per_text(documents: DataFrame, key: str, text: str, schema: str, names: list[str], rows) -> DataFrame:
    """Rows (key, number, ...) of every text by `rows`, inside the scan's partitions; null text is empty."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [(k, i, *r) for k, t in zip(df[key], df[text]) for i, r in enumerate(rows(t or ""))]
            if out:
                yield pd.DataFrame(out, columns=[key, *names])

    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, {schema}")


def sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, section, block)."""
    return _per_text(documents, key, text, "block_no int, section string, block string", ["block_no", "section", "block"], blocks)


def chunk_markdown(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, text)."""
    _check(size, overlap)
    return _per_text(documents, key, text, "chunk_index int, text string", ["chunk_index", "text"], lambda t: [(c,) for c in pieces(t, size, overlap)])
