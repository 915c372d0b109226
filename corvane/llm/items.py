"""The two kinds of text items of the report library as one stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def items(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_type, item, page_no, text): every page of every plan, and every chunk with page_no 0.

    Null pages and null texts stay null. Repeats stay; no row is moved.
    """
    pages = plans.select(F.col("source").alias("item"), F.posexplode("pages").alias("page_no", "text")).select(F.lit("page").alias("item_type"), "item", (F.col("page_no") + 1).cast("int").alias("page_no"), "text")
    return pages.unionByName(chunks.select(F.lit("chunk").alias("item_type"), F.col("id").alias("item"), F.lit(0).alias("page_no"), "text"))
