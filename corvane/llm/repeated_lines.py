"""Lines that one site's documents repeat, kept as incremental line counts per site.

The state is a named folder of tables that outlives the session: the lines of every chunk (as 64-bit keys), the site of
every document, and for every (site, line) the number of documents that hold it, each merge's share apart. A new
partition of chunks is merged as a delta: its new (document, line) pairs are counted, the lines that cross the threshold
are looked for among those the delta holds and those that were excessive before, and only the chunks that are new or hold
such a line are built again.

A site is a publisher; a document belongs to it if any of its chunks, of any partition, names the publisher. Two lines
are the same if only case, spacing, punctuation, markup, escapes, digits or dates differ.

Scale: the text is read once; what travels are 16-byte (document, line) pairs, already distinct per task, hashed by both
parts so that neither a hot site nor a hot line meets in one task; counts are combined before their shuffle. A merge
reads the state's short rows, but shuffles only the delta's. The set of repeated lines has at most 5 times a document's mean number of lines per site; it is written first, so that the planner
knows its size and broadcasts it only below its threshold.

Defined results: null texts have no lines, null sources are no documents, documents without a publisher have no site;
lines without letters don't count; repeats of a chunk count once; ties at the threshold are excessive; further columns
are ignored; an empty table gives no lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import new_path
from corvane.tables import spread

MIN_SHARE, MIN_DOCUMENTS = 0.2, 5
#: The partitions that a whole table is merged in.
PARTS = 2

# Month names and their short forms in English, German, French and Spanish.
_MONTHS = (
    "january february march april may june july august september october november december "
    "januar februar märz maerz mai juni juli oktober dezember "
    "janvier février fevrier mars avril juin juillet août aout septembre octobre novembre décembre decembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre "
    "jan feb mar mrz apr jun jul aug sep sept oct okt nov dec dez janv févr avr juil ene abr ago dic"
).split()


def _trie(words: set[str]) -> str:
    """A pattern for any of the words that looks at each character once."""
    heads = sorted({w[0] for w in words if w})
    parts = [h + _trie({w[1:] for w in words if w[:1] == h}) for h in heads]
    if not parts:
        return ""
    return (parts[0] if len(parts) == 1 and "" not in words else "(?:" + "|".join(parts) + ")") + ("?+" if "" in words else "")


_B = r"[^\S\n]"  # blanks within a line
_MONTH = rf"{_trie(set(_MONTHS))}(?![\p{{L}}\p{{N}}])"
_DATES = rf"(?<![\p{{L}}\p{{N}}])(?:\d{{1,2}}(?:st|nd|rd|th|er|\.|º)?{_B}*+(?:(?:de|of){_B}++)?{_MONTH}\.?(?:,?{_B}++(?:del?{_B}++)?\d{{2,4}})?|{_MONTH}(?:\.?{_B}++\d{{1,2}}(?:st|nd|rd|th)?(?![\p{{L}}\p{{N}}]))?)"
_MARKUP = r"&(?:[a-z]{2,8}|#\d{1,7}|#x[0-9a-f]{1,6});|<[^<>\n]{1,200}>|\]\([^)\n]*\)|\\u[0-9a-f]{4}|\\x[0-9a-f]{2}|\\[nrt](?![a-z])|%[0-9a-f]{2}|\((?:c|r|tm)\)"


def line_keys(text: Column) -> Column:
    """The 64-bit keys of a text's lines in order: equal for lines that count as the same, 0 for lines without letters.

    The text is cleaned as a whole and split afterwards, so each pattern passes over it once.
    """
    letters = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), _MARKUP, " "), _DATES, ""), r"[^\p{L}\n]++", "")
    return F.transform(F.split(letters, "\n"), lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(x)))


def site_name(publisher: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(publisher, r"^\s+|\s+$", "")), r"^www\.", ""), F.lit(""))


def line_table(chunks: DataFrame) -> DataFrame:
    """(id, doc, site, keys): the key of each line of a chunk, without its text."""
    chunks = spread(chunks.filter("source IS NOT NULL").select("id", "source", "publisher", "text"))
    return chunks.select("id", F.xxhash64("source").alias("doc"), site_name(F.col("publisher")).alias("site"), line_keys(F.coalesce("text", F.lit(""))).alias("keys"))


_TABLES = {
    "lines": "id string, doc bigint, site string, keys array<bigint>", "sites": "doc bigint, site string",
    "counts": "site string, key bigint, n bigint", "repeated": "site string, key bigint, n bigint, of_documents bigint",
}


@dataclass(frozen=True)
class LineState:
    """A folder of tables, each merge's rows apart; version 0 is empty. `repeated` is whole in every version, the others grow.

    A merge becomes visible by its last write, the mark of its version; what a lost merge left behind is overwritten.
    """

    spark: SparkSession
    path: str
    version: int

    def part(self, name: str, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}/{version}")

    def all(self, name: str, since: int = 1) -> DataFrame:
        """The rows of every merge from `since` to this version."""
        return self.spark.read.schema(_TABLES[name]).parquet(*paths) if (paths := [f"{self.path}/{name}/{v}" for v in range(since, self.version + 1)]) else self.part(name, 0)

    @property
    def repeated(self) -> DataFrame:
        return self.part("repeated", self.version)

    @property
    def lines(self) -> DataFrame:
        return self.all("lines")

    @property
    def sites(self) -> DataFrame:
        return self.all("sites")


def open_state(spark: SparkSession, path: str | None = None) -> LineState:
    """The state kept under `path`, as far as it was completed; without a path an empty one in the shared folder."""
    if path is None:
        return LineState(spark, new_path(spark, "line-state"), 0)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in files.listStatus(folder)] if files.exists(folder) else []
    return LineState(spark, path, max(done, default=0))


def _pairs(lines: DataFrame) -> DataFrame:
    return lines.select("doc", F.explode(F.array_distinct("keys")).alias("key")).filter("key <> 0").distinct()


def merge(state: LineState, chunks: DataFrame, min_share: float = MIN_SHARE, min_documents: int = MIN_DOCUMENTS) -> LineState:
    """The state after a further partition of chunks. Only the delta is shuffled, and of the counts what it touches.

    A line can become excessive only by a delta that holds it, and cease to be only if it was before: no other is looked at.
    """
    new = LineState(state.spark, state.path, state.version + 1)

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{new.path}/{name}/{new.version}")
        return new.part(name, new.version)

    first = state.version == 0
    delta = write(line_table(chunks), "lines")
    seen = delta.select("doc", "site").filter("site IS NOT NULL").groupBy("doc").agg(F.max("site").alias("site"))
    newly = write(seen if first else seen.join(state.sites, "doc", "left_anti"), "sites")
    fresh = _pairs(delta)
    if not first:
        of_delta = delta.select("doc").distinct()
        fresh = fresh.join(_pairs(state.lines.join(of_delta, "doc", "left_semi")), ["doc", "key"], "left_anti")
        # Documents whose site is known only now bring the lines they were seen with before.
        late = _pairs(state.lines.join(newly, "doc", "left_semi"))
        fresh = fresh.unionByName(late).distinct()
    added = fresh.join(new.sites, "doc").groupBy("site", "key").agg(F.count("*").alias("n"))
    added = write(added, "counts")
    totals = new.sites.groupBy("site").agg(F.count("*").alias("of_documents"))
    counts = added
    if not first:
        touched = added.select("site", "key").unionByName(state.repeated.select("site", "key")).distinct()
        counts = added.unionByName(state.all("counts").join(touched, ["site", "key"], "left_semi")).groupBy("site", "key").agg(F.sum("n").alias("n"))
    often = counts.filter(F.col("n") >= min_documents).join(totals, "site").filter(F.col("n") >= F.col("of_documents") * min_share)
    write(often.select("site", "key", "n", "of_documents"), "repeated")
    state.spark.range(1).write.mode("overwrite").parquet(f"{new.path}/done/{new.version}")
    return new


def crossed(old: LineState, new: LineState) -> tuple[DataFrame, DataFrame]:
    """(risen, fallen): the (site, key) that became excessive between two versions, and those that ceased to be."""
    keys = lambda s: s.repeated.select("site", "key")
    return keys(new).join(keys(old), ["site", "key"], "left_anti"), keys(old).join(keys(new), ["site", "key"], "left_anti")


def occurrences(state: LineState, keys: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(id, line_no): the repeated lines, or those of `keys` (site, key), in the chunks of their sites or in `lines`."""
    keys = state.repeated.select("site", "key") if keys is None else keys
    rows = (state.lines if lines is None else lines).select("id", "doc", F.posexplode("keys").alias("pos", "key")).filter("key <> 0").select("id", "doc", (F.col("pos") + 1).alias("line_no"), "key")
    hit = rows.join(keys.select("key").distinct(), "key", "left_semi").join(state.sites, "doc")
    return hit.join(keys, ["site", "key"], "left_semi").select("id", "line_no").distinct()


def to_rebuild(old: LineState, new: LineState) -> DataFrame:
    """(id): the chunks that came since `old`, and those that hold a line that crossed the threshold or whose document's
    site became known since."""
    risen, fallen = crossed(old, new)
    moved = occurrences(new, risen.unionByName(fallen)).select("id")
    located = new.lines.join(new.all("sites", old.version + 1), "doc", "left_semi").select("id")
    return new.all("lines", old.version + 1).select("id").unionByName(moved).unionByName(located).distinct()


def rebuild(old: LineState, new: LineState, chunks: DataFrame) -> DataFrame:
    """(id, text, n_removed): the texts without their repeated lines of the chunks that need it, and of no others."""
    ids = to_rebuild(old, new)
    lines = new.lines.join(ids, "id", "left_semi")
    return without_lines(chunks.join(ids, "id", "left_semi"), occurrences(new, lines=lines))


def parts_of(chunks: DataFrame, parts: int) -> list[DataFrame]:
    """The chunks in partitions as they were indexed, of about equal size; those without a time come first."""
    if parts < 2:
        return [chunks]
    day = F.datediff(F.to_date("indexed_at"), F.lit("1970-01-01"))
    cuts = chunks.agg(F.percentile_approx(day, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000)).alias("q")).head()["q"] or []
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce((day > c).cast("int"), F.lit(0))
    return [chunks.filter(part == k) for k in range(parts)]


def merged(chunks: DataFrame, parts: int = PARTS, min_share: float = MIN_SHARE, min_documents: int = MIN_DOCUMENTS) -> list[LineState]:
    """The empty state and the state after each partition."""
    states = [open_state(chunks.sparkSession)]
    for part in parts_of(chunks, parts):
        states.append(merge(states[-1], part, min_share, min_documents))
    return states


def repeated_lines(chunks: DataFrame, min_share: float = MIN_SHARE, min_documents: int = MIN_DOCUMENTS, parts: int = PARTS) -> DataFrame:
    """(id, line_no) of the whole table, merged partition by partition."""
    return occurrences(merged(chunks, parts, min_share, min_documents)[-1])


def without_lines(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(id, text, n_removed): each distinct chunk without its lines in `found` (id, line_no)."""
    drop = found.groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("t"), (i + 1).alias("n"))), lambda x: ~F.array_contains("drop", x["n"]))
    # The repeats of a chunk are dropped by the small side of its key, not by comparing texts: equal ids are equal rows.
    return chunks.select("id", "text").join(drop, "id", "left").select(
        "id",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["t"]), "\n")).alias("text"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"),
    ).dropDuplicates(["id"])


def cleaned(chunks: DataFrame, parts: int = PARTS) -> DataFrame:
    """(id, text, n_removed) of every chunk: each merge rebuilds what it concerns, and a chunk's last rebuilding holds."""
    states = merged(chunks, parts)
    out = None
    for old, new in zip(states, states[1:]):
        later = new.version < len(states) - 1
        fresh = rebuild(old, new, chunks)
        if later:  # what a later merge rebuilds again isn't built now
            fresh = fresh.join(to_rebuild(new, states[-1]), "id", "left_anti")
        out = fresh if out is None else out.unionByName(fresh)
    return out


def incremental(chunks: DataFrame, parts: int = PARTS) -> DataFrame:
    """(part, n_risen, n_fallen, n_new, n_rebuilt) per merge: lines that crossed, chunks that came, chunks built (again)."""
    states = merged(chunks, parts)
    rows = []
    for old, new in zip(states, states[1:]):
        risen, fallen = crossed(old, new)
        count = lambda df, name: df.agg(F.count("*").alias(name))
        row = count(risen, "n_risen")
        for df, name in ((fallen, "n_fallen"), (new.part("lines", new.version).select("id").distinct(), "n_new"), (to_rebuild(old, new), "n_rebuilt")):
            row = row.crossJoin(count(df, name))  # one row each
        rows.append(row.select(F.lit(new.version - 1).alias("part"), "n_risen", "n_fallen", "n_new", "n_rebuilt"))
    return reduce(DataFrame.unionByName, rows)
