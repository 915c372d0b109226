"""Delimited files whose schema drifts: one consistent table of records, and every change from file to file.

Rows are loaded as path-value maps with raw text values; the types of each path are aggregated by file; typed columns
are projected from the maps, and values that don't fit their type are reported instead of being lost.

Defined results
---------------
* Null text counts as a blank line, null category or folder is kept; a file without a folder has no predecessor.
* Repeated rows of either table count once. A file whose lines are missing, blank or comments has no fields.
* Short rows lack their last values, surplus cells are ignored.
* Two columns of a file that stand for one field: the one with the field's own name, else the first, is the field; the
  others are extra fields.
* Equal `collected_at` is ordered by `manifest_id`.
* Further columns of the inputs, whatever their names, are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ("status", "url", "filename", "domain", "detected_year", "size_bytes", "sha256", "error")

# Header spellings that stand for a field.
ALIASES = {
    "status": ("state",),
    "url": ("source_url", "link"),
    "filename": ("path", "pdf", "local_path", "file"),
    "domain": ("host", "source_domain", "publisher_host", "site"),
    "detected_year": ("year_guess", "year_score", "yr", "pub_year"),
    "size_bytes": ("bytes", "filesize"),
    "sha256": ("checksum", "digest"),
    "error": ("err_msg",),
}

_DELIMITERS = (",", ";", "\t", "|")
_BOM = "﻿"


def _bare(c: Column) -> Column:
    """Without BOM and outer blanks of any kind."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$", "")


def _is_data(line: Column) -> Column:
    bare = _bare(F.coalesce(line, F.lit("")))
    return (bare != "") & ~bare.startswith("#")


def _count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _delimiter(header: Column) -> Column:
    outside = F.regexp_replace(header, r'"[^"]*"', "")
    best = F.array_max(F.array(*[F.struct(_count_of(outside, d).alias("n"), F.lit(-i).alias("i")) for i, d in enumerate(_DELIMITERS)]))
    return F.element_at(F.array(*[F.lit(d) for d in _DELIMITERS]), 1 - best["i"])


def cells(line: Column, delimiter: Column) -> Column:
    """The cells of one delimited line; quoted cells lose their quotes, doubled quotes are one."""
    d = F.when(delimiter == "|", F.lit("\\|")).when(delimiter == "\t", F.lit("\\t")).otherwise(delimiter)
    pattern = F.concat(d, F.lit('( *+"(?:[^"]++|"")*+" *+(?='), d, F.lit("|$)|[^"), d, F.lit("]*+)"))
    raw = F.regexp_extract_all(F.concat(delimiter, line), pattern, F.lit(1))
    return F.transform(raw, lambda x: F.when(F.trim(x).rlike('^(?s)".*"$'), F.replace(F.regexp_replace(x, '^\\s*"|"\\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(x))


def _distinct(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names).distinct()


def load(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, records): headers have (manifest_id, delimiter, header_line_no, names, paths); records (manifest_id, line_no, paths, cells).

    The header of a file is found by a partial minimum per file, so only one small row of a file travels.
    """
    rows = lines.select("manifest_id", "line_no", "line_text").filter(_is_data(F.col("line_text")))
    first = rows.groupBy("manifest_id").agg(F.min(F.struct("line_no", "line_text")).alias("h"))
    delimiter = _delimiter(F.regexp_replace(F.col("h.line_text"), _BOM, ""))
    headers = (
        first.select("manifest_id", F.col("h.line_no").alias("header_line_no"), delimiter.alias("delimiter"), F.regexp_replace(F.col("h.line_text"), _BOM, "").alias("t"))
        .select("manifest_id", "header_line_no", "delimiter", F.transform(cells(F.col("t"), F.col("delimiter")), lambda x: _bare(x)).alias("headers"))
        .withColumn("names", F.transform("headers", lambda x: F.lower(x)))
        .withColumn("paths", F.transform("names", lambda name, i: F.concat(i.cast("string"), F.lit("/"), name)))
    )
    records = (
        rows.join(headers, "manifest_id")
        .filter(F.col("line_no") > F.col("header_line_no"))
        .withColumn("cells", cells(F.regexp_replace(F.col("line_text"), _BOM, ""), F.col("delimiter")))
        .filter(F.transform("cells", lambda x: F.lower(_bare(x))) != F.col("names"))
        .select("manifest_id", "line_no", "paths", "cells")
    )
    return headers, records


def raw_type(value: Column) -> Column:
    """The type that one value shows; the first that fits."""
    return (
        F.when(value.rlike(r"^[+-]?\d+$"), "integer")
        .when(value.rlike(r"^[+-]?\d*\.\d+$"), "decimal")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull(), "date")
        .when(value.rlike(r"^(?i)https?://\S+$"), "url")
        .when(value.rlike(r"^(?i)[0-9a-f]{64}$"), "digest")
        .when(value.rlike(r"(?i)\.(pdf|md|txt|docx?|html?|csv)$"), "file")
        .when(value.rlike(r"^(?i)[a-z0-9-]+(\.[a-z0-9-]+)+$"), "host")
        .otherwise("text")
    )


def path_values(records: DataFrame) -> DataFrame:
    """(manifest_id, line_no, values): each record as a map from path to raw value; a path is the column's place and header.

    Short rows lack their last paths, surplus cells have none.
    """
    n = F.least(F.size("paths"), F.size("cells"))
    return records.select("manifest_id", "line_no", F.map_from_arrays(F.slice("paths", F.lit(1), n), F.slice("cells", F.lit(1), n)).alias("values"))


def path_types(lines: DataFrame) -> DataFrame:
    """One row per file and path: position, header, field, type (null without values) and number of values.

    The statistics are counts by file, path and raw type, combined before their shuffle.
    """
    headers, records = load(lines)
    values = path_values(records).select("manifest_id", F.explode("values").alias("path", "value")).withColumn("value", _bare(F.col("value"))).filter("value <> ''")
    typed = values.select("manifest_id", "path", raw_type(F.col("value")).alias("t"))
    of = lambda *types: F.count_if(F.col("t").isin(*types))
    counts = typed.groupBy("manifest_id", "path").agg(
        F.count("*").alias("n_values"), of("integer").alias("integers"), of("integer", "decimal").alias("decimals"), of("date").alias("dates"), of("url").alias("urls"),
        of("digest").alias("digests"), of("host").alias("hosts"), of("file").alias("files"),
    ).withColumn("pos", F.substring_index("path", "/", 1).cast("int"))
    columns = headers.select("manifest_id", F.posexplode("headers").alias("pos", "header")).withColumn("name", F.lower("header")).join(counts, ["manifest_id", "pos"], "left")
    known = F.create_map(*[F.lit(x) for field, names in ALIASES.items() for alias in (field, *names) for x in (alias, field)])
    every = lambda k: F.col(k) == F.col("n_values")
    said = F.element_at(known, F.col("name"))
    # A header that says nothing: what all its values are, where the file has no such field by name.
    looks = F.when(every("urls"), "url").when(every("digests"), "sha256").when(every("hosts"), "domain").when(every("files"), "filename")
    file = Window.partitionBy("manifest_id")
    typed = (
        columns.withColumn("said", said)
        .withColumn("names_said", F.collect_set("said").over(file))
        .withColumn("looks", F.when(F.col("said").isNull(), looks))
        .withColumn("looks", F.when(~F.array_contains("names_said", F.col("looks")), F.col("looks")))
        .withColumn("meant", F.coalesce("said", "looks"))
    )
    rank = F.row_number().over(Window.partitionBy("manifest_id", "meant").orderBy((F.col("name") != F.col("meant")).cast("int"), "pos"))
    kind = (
        F.when(F.col("n_values").isNull(), F.lit(None).cast("string"))
        .when(every("integers"), "integer")
        .when(every("decimals"), "decimal")
        .when(every("dates"), "date")
        .otherwise("text")
    )
    return typed.withColumn("rank", rank).select(
        "manifest_id", "pos", "header", "name",
        F.when(F.col("meant").isNotNull() & (F.col("rank") == 1), F.col("meant")).otherwise(F.col("name")).alias("field_name"),
        kind.alias("type"), F.coalesce("n_values", F.lit(0)).alias("n_values"),
    )


def drift(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(manifest_id, field_name, drift): each change against the file directly before in the folder.

    One window over the folder's files carries the previous file's short list of fields; records never meet in it.
    """
    fields = (
        path_types(lines)
        .groupBy("manifest_id", "field_name")
        .agg(F.min_by(F.struct("name", "type"), "pos").alias("x"))
        .groupBy("manifest_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("field_name", "x"))).alias("fields"))
    )
    ordered = _distinct(files, "manifest_id", "folder", "collected_at").filter("folder IS NOT NULL").join(fields, "manifest_id", "left")
    before = Window.partitionBy("folder").orderBy("collected_at", "manifest_id")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<name:string,type:string>>"))
    pairs = (
        ordered.withColumn("fields", F.coalesce("fields", none))
        .withColumn("old", F.lag("fields").over(before))
        .filter("old IS NOT NULL")
        .select("manifest_id", "fields", "old", F.explode(F.array_union(F.map_keys("fields"), F.map_keys("old"))).alias("field_name"))
        .select("manifest_id", "field_name", F.element_at("fields", F.col("field_name")).alias("now"), F.element_at("old", F.col("field_name")).alias("was"))
    )
    both = F.col("now").isNotNull() & F.col("was").isNotNull()
    changes = F.array(
        F.when(F.col("was").isNull(), F.lit("added")),
        F.when(F.col("now").isNull(), F.lit("removed")),
        F.when(both & F.col("field_name").isin(*FIELDS) & (F.col("now.name") != F.col("was.name")), F.lit("renamed")),
        F.when(both & (F.col("now.type") != F.col("was.type")), F.lit("type_changed")),
    )
    return pairs.select("manifest_id", "field_name", F.explode(F.array_compact(changes)).alias("drift")).distinct()


def _values(lines: DataFrame) -> DataFrame:
    """(manifest_id, line_no, values): each record as a map from field to raw value; blank values are absent."""
    _, records = load(lines)
    order = path_types(lines).groupBy("manifest_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field_name"))), lambda x: x["field_name"]).alias("fields"))
    entries = F.filter(F.arrays_zip(F.col("fields"), F.slice(F.col("cells"), F.lit(1), F.size("fields"))), lambda x: x["1"].isNotNull() & (_bare(x["1"]) != "") & x["fields"].isNotNull())
    flat = F.aggregate(entries, F.expr("CAST(array() AS array<struct<k:string,v:string>>)"), lambda a, x: F.when(F.exists(a, lambda e: e["k"] == x["fields"]), a).otherwise(F.concat(a, F.array(F.struct(x["fields"].alias("k"), _bare(x["1"]).alias("v"))))))
    return records.join(order, "manifest_id").select("manifest_id", "line_no", F.map_from_entries(flat).alias("values"))


def records(files: DataFrame, lines: DataFrame) -> DataFrame:
    """All records of all files with the eight fields, the extra fields as JSON and the names of the fields that failed their cast."""
    lines = _distinct(lines, "manifest_id", "line_no", "line_text")
    v = lambda name: F.element_at("values", F.lit(name))
    host = F.regexp_replace(F.lower(F.trim(v("domain"))), r"^www\.", "")
    year = F.nullif(F.regexp_extract(v("detected_year"), r"(?:19|20)\d{2}", 0), F.lit(""))
    size = F.regexp_replace(v("size_bytes"), r"\.0+$", "").try_cast("bigint")
    extra = F.map_filter("values", lambda k, _: ~k.isin(*FIELDS))
    named = files.select("manifest_id", "folder").distinct()
    out = _values(lines).join(named, "manifest_id", "left").select(
        "manifest_id", "line_no", "folder",
        v("status").alias("status"), v("url").alias("url"),
        F.element_at(F.split(F.replace(v("filename"), F.lit("\\"), F.lit("/")), "/"), -1).alias("filename"),
        host.alias("domain"), year.cast("int").alias("detected_year"), size.alias("size_bytes"),
        v("sha256").alias("sha256"), v("error").alias("error"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(extra)))).alias("extra"),
        F.array_join(F.array_compact(F.array(
            F.when(v("detected_year").isNotNull() & year.isNull(), F.lit("detected_year")),
            F.when(v("size_bytes").isNotNull() & size.isNull(), F.lit("size_bytes")),
        )), ",").alias("failed_casts"),
    )
    return out


def failed_casts(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(manifest_id, field_name, n_failed): values of each file that didn't fit their field's type."""
    rows = records(files, lines).filter("failed_casts <> ''")
    return rows.select("manifest_id", F.explode(F.split("failed_casts", ",")).alias("field_name")).groupBy("manifest_id", "field_name").agg(F.count("*").alias("n_failed"))
