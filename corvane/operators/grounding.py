"""Whether an answer is grounded in its hits, and what becomes of it if not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import cited_indices, invalid_citations, renumber_udf

# Fixed value: what is said instead of an answer.
ABSTENTION = "I couldn't find that in the reports I have access to, so I can't answer it reliably. Try rephrasing, or ask about a topic the reports cover."


def caveat(answer: Column, n_hits: Column) -> Column:
    """The answer, with a note on markers that name no hit."""
    bad = invalid_citations(answer, n_hits)
    # Fixed value: the note.
    note = F.concat(F.lit("\n\n_Note: "), F.array_join(F.transform(bad, lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), ", "), F.lit(" could not be matched to a retrieved source and may be unreliable._"))
    return F.when(F.size(bad) > 0, F.concat(answer, note)).otherwise(answer)


def gate(answers: DataFrame, model_verdict: str | None = None) -> DataFrame:
    """Adds grounded, invalid, reason and abstention from (answer, n_hits).

    The reasons are fixed values. Without hits: not grounded, abstain. With invalid markers: not grounded, no abstention. A model's verdict that
    starts with UNSUPPORTED abstains, too. A null answer cites nothing.
    """
    bad = F.coalesce(invalid_citations(F.col("answer"), F.col("n_hits")), F.array().cast("array<bigint>"))
    none = F.col("n_hits") == 0
    unsupported = F.coalesce(F.upper(F.col(model_verdict)).startswith("UNSUPPORTED"), F.lit(False)) if model_verdict else F.lit(False)
    return answers.withColumn("invalid", bad).withColumn("grounded", ~none & (F.size("invalid") == 0) & ~unsupported).withColumn(
        "reason",
        F.when(none, "no supporting context").when(unsupported, "llm judged the answer unsupported by context")
        .when(F.size("invalid") > 0, F.concat(F.lit("citations outside context 1-"), F.col("n_hits").cast("string"), F.lit(": ["), F.array_join(F.col("invalid").cast("array<string>"), ", "), F.lit("]"))).otherwise(""),
    ).withColumn("abstention", F.when(none | unsupported, F.lit(ABSTENTION)))


def answer_gate(answers: DataFrame) -> DataFrame:
    """(…, answer): what a chat says of (answer, n_hits, retrieved): without hits it abstains, if it looked for any; markers
    that name no hit get a note, the answer stays."""
    none = F.coalesce(F.col("retrieved"), F.lit(True)) & (F.col("n_hits") == 0)
    noted = F.when(F.col("n_hits") > 0, caveat(F.col("answer"), F.col("n_hits"))).otherwise(F.col("answer"))
    return answers.withColumn("answer", F.when(none, F.lit(ABSTENTION)).otherwise(noted))


def node_gate(nodes: DataFrame) -> DataFrame:
    """(…, summary, verdict): nodes (summary, sources: array of (source, text)). Skipped if there are sources, but none has text."""
    texts = F.filter("sources", lambda s: F.coalesce(F.length(s["text"]), F.lit(0)) > 0)
    n = F.coalesce(F.size("sources"), F.lit(0))
    skip = (n > 0) & (F.size(texts) == 0)
    bad = F.size(F.coalesce(invalid_citations(F.col("summary"), n), F.array().cast("array<bigint>"))) > 0
    verdict = F.when(skip, "skipped").when(n == 0, "abstained").when(bad, "ungrounded").otherwise("grounded")
    return nodes.withColumn("verdict", verdict).withColumn("summary", F.when(F.col("verdict") == "abstained", F.lit(ABSTENTION)).otherwise(F.col("summary")))


def merge_sources(sources: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, label, position, text): one row per label in the order first seen; texts are joined unless already contained.

    Sources are (by, label, seq, text). The fold is over the texts of one label of one run.
    """
    texts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    per = sources.groupBy(by, "label").agg(F.min("seq").alias("first_seq"), texts.alias("texts"))
    text = F.aggregate("texts", F.lit(""), lambda a, t: F.when(F.contains(a, t), a).when(a == "", t).otherwise(F.concat(a, F.lit("\n\n"), t)))
    place = F.sum(F.lit(1)).over(Window.partitionBy(by).orderBy("first_seq", "label"))
    return per.select(by, "label", place.cast("int").alias("position"), text.alias("text"))


def cited(answers: DataFrame, key: str) -> DataFrame:
    """(key, marker): the distinct markers of each answer."""
    return answers.select(key, F.explode(cited_indices(F.col("answer"))).alias("marker"))


def synthesize(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(run_id, answer, n_sources): the summaries of a run's nodes in the order of the plan, their local markers renumbered.

    Nodes are (run_id, node_id, position, summary), sources (run_id, node_id, local, label). A source has the number of
    its label in the run, in the order first seen; markers without source go; nodes without summary are left out, and a
    run without any says so. A run has as many nodes as its plan.
    """
    seen = sources.join(nodes.select("run_id", "node_id", "position"), ["run_id", "node_id"])
    first = seen.groupBy("run_id", "label").agg(F.min(F.struct("position", "local")).alias("at"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("at", "label")))
    mapping = seen.join(numbered.select("run_id", "label", "n"), ["run_id", "label"]).groupBy("run_id", "node_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("local", "n")))).alias("m"), F.max("local").alias("most"))
    mapped = nodes.join(mapping, ["run_id", "node_id"], "left").withColumn("mapping", F.when(F.col("m").isNotNull(), F.transform(F.sequence(F.lit(1), F.col("most")), lambda i: F.element_at("m", i))).otherwise(F.array().cast("array<int>")))
    texts = mapped.filter(F.coalesce(F.trim("summary"), F.lit("")) != "").withColumn("text", renumber_udf("summary", "mapping"))
    answers = texts.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("answer"))
    count = numbered.groupBy("run_id").agg(F.count("*").alias("n_sources"))
    return nodes.select("run_id").distinct().join(answers, "run_id", "left").join(count, "run_id", "left").select("run_id", F.coalesce("answer", F.lit("No results were produced for this request.")).alias("answer"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
