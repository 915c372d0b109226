"""Keeping a chunk library: keyed changes, deltas by content hash, manifests, recovered text, figures, packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import LINE_END, basename, content_hash, dedup_key, letter_count, publisher_norm, words


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows replaced by key; of several changes of a key the last by `order` holds. Rows without changes aren't compared."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), order).alias("r")).select(key, "r.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last.select(*table.columns))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by partial aggregation instead of a sort."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("r")).select(key, "r.*")


def delete_by(table: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is in `values` go; rows without a value stay."""
    return table.join(values.select(column).distinct(), column, "left_anti")


def fan_out(df: DataFrame, paths: list[str]) -> DataFrame:
    """Written to every path, read from the first. Each copy is complete before the next; not one transaction."""
    if not paths:
        raise ValueError("no place to write to")
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(paths[0])
    first = spark.read.parquet(paths[0])
    for p in paths[1:]:
        first.write.mode("overwrite").parquet(p)
    return first


def delta(current: DataFrame, known: DataFrame) -> DataFrame:
    """(source, action): new, changed, unchanged by content hash, and removed for sources that are gone."""
    a, b = current.select("source", F.col("content_hash").alias("now"), F.lit(True).alias("here")), known.select("source", F.col("content_hash").alias("was"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("changed")
    return a.join(b, "source", "full").select("source", action.alias("action"))


def apply_changes(library: DataFrame, state: DataFrame, files: DataFrame, ingest: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, state, outcome) after taking in `files` (source, content_hash, text) by `ingest`, which gives chunks with a source.

    Files with the known hash are skipped, changed ones lose their old chunks first, files that are gone keep theirs.
    A file without text fails alone: it is in the outcome (source, action), its old chunks and state stay, and the next run
    tries it again. State is (source, content_hash).
    """
    known = state.select("source", F.col("content_hash").alias("was"))
    action = F.when(F.col("was").isNotNull() & (F.col("was") == F.col("content_hash")), "unchanged").when(F.col("text").isNull(), "failed").when(F.col("was").isNull(), "new").otherwise("changed")
    judged = files.select("source", "content_hash", "text").join(known, "source", "left").withColumn("action", action)
    taken = judged.filter(F.col("action").isin("new", "changed"))
    gone = taken.filter("action = 'changed'").select("source")
    chunks = delete_by(library, "source", gone).unionByName(ingest(taken.select("source", "text")).select(*library.columns))
    kept = state.select("source", "content_hash").join(taken.select("source"), "source", "left_anti").unionByName(taken.select("source", "content_hash"))
    return chunks, kept, judged.select("source", "action")


def scan(table: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The first `limit` rows by their key, so that every run gives the same."""
    return table.orderBy(key).limit(limit)


def chunk_metadata(text: Column, index: Column, supplied: Column) -> Column:
    """A chunk's metadata: text, chunk_index and content_hash are derived, but what the caller supplies under these names holds."""
    derived = F.create_map(F.lit("text"), text, F.lit("chunk_index"), index.cast("string"), F.lit("content_hash"), content_hash(text))
    own = F.coalesce(supplied, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(derived, lambda k, _: ~F.map_contains_key(own, k)), own)


def run_summary(actions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files by action, and chunks of the sources that were taken in, by category, as sorted JSON."""
    n = lambda a: F.count_if(F.col("action") == a).alias(f"n_{a}")
    taken = actions.filter(F.col("action").isin("new", "changed")).select("source")
    by = chunks.join(taken, "source", "left_semi").groupBy("category").agg(F.count("*").alias("n"))
    cats = by.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("category", F.lit("uncategorized")), "n"))))).alias("chunks_by_category"))
    return actions.agg(n("new"), n("changed"), n("unchanged"), n("removed")).crossJoin(cats)


def manifest_join(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (source, folder) with the last manifest row of exactly their name in their folder; the folder's category wins."""
    last = manifest.filter("filename IS NOT NULL").groupBy("folder", basename(F.col("filename")).alias("name")).agg(F.max_by(F.struct("publisher", "published_year"), F.struct("manifest_id", "line_no")).alias("m"))
    return files.withColumn("name", basename(F.col("source"))).join(last, ["folder", "name"], "left").select("source", "folder", F.col("m.publisher").alias("publisher"), F.col("m.published_year").alias("published_year"), F.split("folder", "/")[0].alias("category"))


def positional(files: DataFrame, rows: DataFrame, batch: dict[str, str]) -> DataFrame:
    """Upload rows meet files by position (`pos`); blank cells take the batch's value; another number of rows rejects all."""
    n, m = files.count(), rows.count()
    if n != m:
        raise ValueError(f"{m} manifest rows for {n} files")
    fill = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(batch.get(c)))
    return files.join(rows, "pos").select("pos", "source", fill("category").alias("category"), publisher_norm(fill("publisher")).alias("publisher"))


def recover_dropped(pages: DataFrame, least_letters: int = 10, share: float = 0.25, least_pages: int = 3) -> DataFrame:
    """(source, page, recovered) of (source, page, layout_text, plain_text): lines that the layout parser dropped, blanks single.

    Lines with few letters, repeats within the page and running headers (on several pages and a share of them) are left
    out; a page that nothing is recovered of has an empty text. Lines are counted per source and key by a partial
    aggregation.
    """
    lines = pages.select("source", "page", dedup_key(F.coalesce("layout_text", F.lit(""))).alias("have"), F.posexplode(F.split("plain_text", LINE_END)).alias("pos", "line"))
    keyed = lines.filter(letter_count(F.col("line")) >= least_letters).withColumn("key", dedup_key(F.col("line")))
    total = pages.groupBy("source").agg(F.countDistinct("page").alias("n_pages"))
    header = keyed.select("source", "key", "page").distinct().groupBy("source", "key").agg(F.count("*").alias("on_pages")).join(total, "source").filter((F.col("on_pages") >= least_pages) & (F.col("on_pages") >= share * F.col("n_pages")))
    wanted = keyed.filter((F.col("key") != "") & ~F.contains(F.col("have"), F.col("key"))).join(header.select("source", "key"), ["source", "key"], "left_anti")
    once = wanted.groupBy("source", "page", "key").agg(F.min(F.struct("pos", F.array_join(words(F.col("line")), " ").alias("line"))).alias("f"))
    found = once.groupBy("source", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["line"]), "\n").alias("recovered"))
    return pages.select("source", "page").join(found, ["source", "page"], "left").select("source", "page", F.coalesce("recovered", F.lit("")).alias("recovered"))


def align_recovered(layout: DataFrame, recovered: DataFrame) -> DataFrame:
    """(source, page, text): recovered lines after their page where both parsers have as many pages, else after the last page.

    layout: (source, page, text, n_plain_pages); recovered: (source, page, recovered). Pages are counted from 0.
    """
    n = layout.groupBy("source").agg(F.count("*").alias("n"), F.max("n_plain_pages").alias("m"), F.max("page").alias("last"))
    placed = recovered.join(n, "source").select("source", F.when(F.col("n") == F.col("m"), F.col("page")).otherwise(F.col("last")).alias("page"), F.col("page").alias("of"), "recovered")
    more = placed.groupBy("source", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("of", "recovered"))), lambda x: x["recovered"]), "\n").alias("more"))
    return layout.join(more, ["source", "page"], "left").select("source", "page", F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit("\n\n"), "more"), F.lit(""))).alias("text"))


def record_run(summary: DataFrame, path: str) -> None:
    """The last run as a table of one row."""
    summary.withColumn("recorded_at", F.current_timestamp()).write.mode("overwrite").json(path)


_MARK = "<!-- image -->"


def inject_figures(page: Column, texts: Column) -> Column:
    """The k-th image mark becomes the k-th text between blank lines; empty texts drop it; on another number of texts all
    marks go and the texts are appended."""
    parts = F.split(page, _MARK)
    said = lambda t: F.coalesce(t, F.lit("")) != ""
    spliced = F.array_join(F.zip_with(parts, F.concat(texts, F.array(F.lit(""))), lambda p, t: F.concat(p, F.when(said(t), F.concat(F.lit("\n\n"), t, F.lit("\n\n"))).otherwise(""))), "")
    kept = F.filter(texts, said)
    appended = F.concat(F.array_join(parts, ""), F.when(F.size(kept) > 0, F.concat(F.lit("\n\n"), F.array_join(kept, "\n\n"))).otherwise(""))
    return F.when(F.size(parts) - 1 == F.size(texts), spliced).otherwise(appended)


def plan_to_pages(plans: DataFrame, results: DataFrame) -> DataFrame:
    """(source, page_no, text): slots of (source, pages, slots) take their figure's text from results (custom_id, text)."""
    slots = plans.select("source", F.posexplode("slots").alias("pos", "s")).select("source", "pos", "s.page_no", "s.custom_id")
    told = slots.join(results, "custom_id", "left").groupBy("source", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]).alias("texts"))
    pages = plans.select("source", F.posexplode("pages").alias("p", "page")).select("source", (F.col("p") + 1).cast("int").alias("page_no"), "page")
    return pages.join(told, ["source", "page_no"], "left").select("source", "page_no", inject_figures(F.coalesce("page", F.lit("")), F.coalesce("texts", F.array().cast("array<string>"))).alias("text"))


def figure_slots(slots: DataFrame, least_pixels: int, most: int) -> DataFrame:
    """Slots (source, pos, width, height) with a long edge of enough pixels, in order, up to a number per source."""
    big = slots.filter(F.greatest("width", "height") >= least_pixels)
    return big.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("pos"))).filter(F.col("n") <= most).drop("n")


def greedy_pack(sizes: DataFrame, cap: int, by: str = "run_id") -> DataFrame:
    """(by, seq, batch_no): requests in order, a new batch whenever the next would exceed the cap.

    Where a batch ends depends on where it began, so one run's sizes are folded in order; runs are independent.
    """
    kind = sizes.schema[by].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, used, no = object(), 0, 0
        for df in batches:
            out = []
            for b, seq, n in df.itertuples(index=False):
                if b != run:
                    run, used, no = b, 0, 0
                elif used + n > cap:
                    used, no = 0, no + 1
                used += n
                out.append((b, seq, no))
            yield pd.DataFrame(out, columns=[by, "seq", "batch_no"])

    return sizes.select(by, "seq", "bytes").repartition(by).sortWithinPartitions(by, "seq").mapInPandas(fold, f"{by} {kind}, seq bigint, batch_no int")


def history(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("seq"))
    return messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def render_history(turns: DataFrame) -> DataFrame:
    """(conversation_id, history): oldest first."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("seq", "question", "answer"))), lambda t: F.concat(F.lit("User: "), F.coalesce(t["question"], F.lit("")), F.lit("\nAssistant: "), F.coalesce(t["answer"], F.lit(""))))
    return turns.groupBy("conversation_id").agg(F.array_join(line, "\n").alias("history"))
