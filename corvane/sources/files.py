"""Reading documents, manifests and gold queries; writing results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import path_category

SUFFIXES = (".txt", ".md", ".pdf", ".docx")


def walk(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(source, suffix, content, size, content_hash, category) of the supported files under a folder, whatever their case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file://"))
    source = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^/?{base.lstrip('/')}/", "")
    out = files.select(source.alias("source"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))
    suffix = F.lower(F.regexp_extract("source", r"(\.[^./\\]+)$", 1))
    return out.withColumn("suffix", suffix).filter(F.col("suffix").isin(*suffixes)).withColumn("category", path_category(F.col("source")))


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, one per line."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def docx_title(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("docProps/core.xml"))
        return next((e.text for e in root.iter() if e.tag.endswith("}title") and e.text), None)
    except Exception:  # a title is never worth failing for
        return None


def _pdf_pages(content: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF files needs a parser: install pypdf or pass one") from e
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def load(files: DataFrame, pdf: Callable[[bytes], list[str]] = _pdf_pages) -> DataFrame:
    """(source, title, pages, error) of (source, suffix, content); a file that can't be read gives its error, not a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for source, suffix, content in df.itertuples(index=False):
                stem = re.split(r"[/\\]", source)[-1].rsplit(".", 1)[0]
                try:
                    content = bytes(content)
                    if suffix in (".txt", ".md"):
                        title, pages = None, [content.decode("utf-8-sig", "replace")]
                    elif suffix == ".docx":
                        title, pages = docx_title(content), [docx_text(content)]
                    elif suffix == ".pdf":
                        title, pages = None, pdf(content)
                    else:
                        raise ValueError(f"unsupported type {suffix}")
                    out.append((source, title or stem, pages, None))
                except Exception as e:
                    out.append((source, stem, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source", "title", "pages", "error"])

    return files.select("source", "suffix", "content").mapInPandas(run, "source string, title string, pages array<string>, error string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV with the spellings of its columns resolved; missing columns are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    names = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    pick = lambda *cs: F.coalesce(*[F.col(f"`{names[c]}`") for c in cs if c in names], F.lit(None).cast("string"))
    return df.select(pick("filename").alias("filename"), pick("domain", "source_domain").alias("domain"), pick("detected_year").alias("detected_year"), pick("year_score").alias("year_score"), pick("url").alias("url"), pick("status").alias("status"))


def gold_queries(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a JSON file {"queries": [...]}, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def migrate(table: DataFrame, path: str, expected: int | None = None) -> int:
    """Rows with text to a new place; the number of rows is checked before it counts as done."""
    kept = table.filter(F.length("text") > 0)
    kept.write.mode("errorifexists").parquet(path)
    n = table.sparkSession.read.parquet(path).count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows written, {expected} expected")
    return n
