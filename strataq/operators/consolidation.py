"""What consolidation and compaction make of memories: outputs by family, windows, jobs, summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from strataq.functions import text as T
from strataq.operators import knowledge as K
from strataq.operators import log as L
from strataq.operators import retrieval as Q


def derived(prefix: str, id_: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(id_, 256), 1, 24))


def outputs(moments: DataFrame) -> DataFrame:
    """(family, id, source_id, text) of what each memory comes to: knowledge always, a summary or a category if it is one, an embedding if it has a vector."""
    out = lambda family, prefix: F.struct(F.lit(family).alias("family"), derived(prefix, F.col("id")).alias("id"))
    own = lambda family: F.struct(F.lit(family).alias("family"), F.col("id").alias("id"))
    vector = F.col("vector").isNotNull() if "vector" in moments.columns else F.lit(False)
    parts = F.array_compact(F.array(out("knowledge", "know"), F.when(F.col("kind") == "memory_summary", own("summaries")), F.when(F.col("kind") == "memory_category", own("categories")), F.when(vector, out("embeddings", "emb"))))
    return moments.select(F.col("id").alias("source_id"), "text", F.inline(parts)).select("family", "id", "source_id", "text")


def job(made: DataFrame, moments: int, associations: int, windows: int) -> DataFrame:
    """One row with what a consolidation wrote."""
    n = lambda family: F.count_if(F.col("family") == family)
    return made.agg(n("knowledge").alias("knowledge"), n("summaries").alias("summaries"), n("categories").alias("categories"), n("embeddings").alias("embeddings")).select(
        "*", F.lit(moments).cast("long").alias("moments"), F.lit(associations).cast("long").alias("associations"), F.lit(windows).cast("long").alias("windows")
    )


def windows(labelled: DataFrame, edges: DataFrame, most: int = 24) -> DataFrame:
    """Of (node, component, seq, stream, task_id, text) and the edges inside: one row for each component, the newest first as window_1, window_2 and so on.

    size, edges, stream (mixed if there are several), task_ids, first and last sequence
    numbers, and the first keywords.  Windows are numbered by range, not in one task.
    """
    words = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.slice(T.keywords(F.col("text")), 1, most).alias("k")))), lambda x: x["k"])))
    sizes = labelled.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.min("stream").alias("_a"), F.max("stream").alias("_b"), F.sort_array(F.collect_set("task_id")).alias("task_ids"),
        F.min("seq").alias("oldest"), F.max("seq").alias("newest"),
    )
    # The first memories of a component give the keywords: the 24 oldest have 24 distinct ones, if there are as many.
    early = L.newest(labelled.withColumn("_back", -F.col("seq")), ["component"], most, "_back").groupBy("component").agg(F.slice(words, 1, most).alias("keywords"))
    of = edges.join(labelled.select(F.col("node").alias("source_id"), "component"), "source_id").groupBy("component").agg(F.countDistinct("id").alias("edges"))
    out = sizes.join(early, "component").join(of, "component", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))
    out = out.withColumn("stream", F.when(F.col("_a") != F.col("_b"), "mixed").otherwise(F.col("_a"))).drop("_a", "_b")
    return Q.numbered(out, F.desc("newest"), F.col("component")).withColumn("window", F.concat(F.lit("window_"), F.col("rank").cast("string")))


def knowledge_rows(moments: DataFrame, kind: str) -> DataFrame:
    """Knowledge events of memories; texts are cut at 500 characters."""
    return moments.select(F.lit(kind).alias("type"), F.left("text", F.lit(500)).alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("summary"), F.col("id").alias("source_id"), "rank")


def compacted_knowledge(moments: DataFrame, events: DataFrame, latest: int = 20) -> DataFrame:
    """(type, name, summary, text, source_id, seq) that the default compaction leaves; seq is its place.

    A summary (the first there is, else of the strongest memories), the five strongest
    summaries as facts, the latest ingestions, and the skills, procedures and facts there
    were; of equal ones the last stays.  ``events`` has type, name,
    summary, text, source_id and seq.
    """
    spark = moments.sparkSession
    old = events.filter("type = 'summary'").orderBy("seq").select("summary").limit(1).collect()
    text = old[0][0] if old and old[0][0] is not None else K.compact_summary(moments).first()["summary"]
    head = spark.createDataFrame([("summary", text, None, text, None, 1)], "type string, text string, name string, summary string, source_id string, rank long")
    facts = knowledge_rows(Q.top(moments.filter("kind = 'memory_summary'"), 5, F.desc("attention"), F.col("seq")), "fact")
    recent = knowledge_rows(Q.top(moments.filter(~F.coalesce(F.col("kind"), F.lit("")).isin("memory_summary", "memory_category")), latest, F.desc("seq"), F.col("id")), "latest_ingestion")
    kept = events.filter(F.col("type").isin("skill", "procedure", "fact")).select("type", "text", "name", "summary", "source_id", F.col("seq").alias("rank"))
    rows = None
    for k, part in enumerate((head, facts, recent, kept)):
        part = part.withColumn("seq", F.struct(F.lit(k).alias("part"), F.col("rank").cast("long").alias("rank"))).drop("rank")
        rows = part if rows is None else rows.unionByName(part)
    return K.deduped(rows)


def semantic_summary(records: DataFrame) -> DataFrame:
    """(family, count, source_ids): what a semantic compaction says of the records that it was given, which are bounded by its limit."""
    return records.groupBy("family").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("id")).alias("source_ids"))


def semantic(records: DataFrame, families: list[str], limit: int = 1000, adapter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Selects the strongest records of some families and summarises them, or has an adapter do so.

    Records have family, id, seq and payload; priority is the payload's attention, else
    its confidence, else 0.
    """
    number = lambda f: F.get_json_object("payload", f"$.{f}").cast("double")
    chosen = L.strongest(records.filter(F.col("family").isin(*families)), F.coalesce(number("attention"), number("confidence")), limit)
    return (adapter or semantic_summary)(chosen)
