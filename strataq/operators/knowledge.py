"""The knowledge log's events: ranking, search, budgets, compaction, skills."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataq.functions import text as T

# Priorities of event types, and the types of a packet in order.
PRIORITY = {"summary": 100, "skill": 90, "procedure": 80, "fact": 70, "latest_ingestion": 60, "compaction_marker": 10}
PACKET_TYPES = ("skill", "procedure", "fact", "latest_ingestion")
MARKER = r"^\s*(?:[-*+]|\d+[.)])\s+"


def priority(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[kind], F.lit(0))


def rank_order() -> list[Column]:
    return [F.desc(priority(F.col("type"))), F.desc("usage"), F.desc("attention"), F.desc("seq"), F.asc("id")]


def searched(events: DataFrame, cue: str) -> DataFrame:
    """Score of each event: shared terms, phrase, type, usage and attention; type alone makes it positive but for markers."""
    want = list(dict.fromkeys(w for w in re.split("[^a-z0-9_]+", cue.lower()) if len(w) >= 3))
    shared = F.size(F.array_intersect(T.ascii_terms(F.col("text")), F.array(*[F.lit(w) for w in want]))) if want else F.lit(0)
    phrase = F.when(F.lit(cue != "") & F.contains(F.lower("text"), F.lit(cue.lower())), 4).otherwise(0)
    score = 3 * shared + phrase + F.floor(priority(F.col("type")) / 25) + F.least("usage", F.lit(5)) + F.floor(F.least(F.col("attention"), F.lit(5)))
    return events.withColumn("score", score.cast("long")).filter("score > 0")


def budget_per_type(events: DataFrame, limit: int, budget: int) -> DataFrame:
    """Ranked events type by type, each cut at its limit or its first event over what is left of the byte budget."""
    w = Window.partitionBy("type").orderBy(*rank_order())
    # A type keeps its first ``limit`` events at most, so the sums run over few rows.
    rows = events.filter(F.col("type").isin(*PACKET_TYPES)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    rows = rows.withColumn("_sum", F.sum("bytes").over(w))
    used, parts = 0, []
    for kind in PACKET_TYPES:
        kept = rows.filter((F.col("type") == kind) & (F.col("_sum") <= budget - used))
        used += kept.agg(F.sum("bytes")).first()[0] or 0
        parts.append(kept)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("_n", "rank").drop("_sum")


def deduped(events: DataFrame) -> DataFrame:
    """The last event of each (type, name, else summary, else text)."""
    key = F.coalesce("name", "summary", "text")
    return events.groupBy("type", key.alias("_k")).agg(F.max_by(F.struct(*events.columns), "seq").alias("_r")).select("_r.*")


def compact_summary(moments: DataFrame) -> DataFrame:
    """One row: the five strongest texts, or a fixed sentence."""
    best = moments.orderBy(F.desc("attention"), "seq").limit(5)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("attention")).alias("a"), "seq", "text"))), lambda x: F.left(x["text"], F.lit(500))), " | ")
    return best.agg(F.when(F.count(F.lit(1)) == 0, "No compact knowledge has been built yet.").otherwise(text).alias("summary"))


def skills(texts: DataFrame) -> DataFrame:
    """name and steps of a skill's text: the first line's first sentence without its marker; bulleted and numbered lines, else the whole text."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|[\n\x0B\f\r]"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), MARKER, "")
    name = F.trim(F.get(F.split(first, r"(?<=[.!?])\s+", 2), F.lit(0)))
    steps = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, MARKER + "(.+)$", 1))), lambda x: x != "")
    return texts.withColumn("name", name).withColumn("steps", F.when(F.size(steps) > 0, steps).otherwise(F.array(F.trim("text")))).filter("name <> ''")


def normalised(events: DataFrame) -> DataFrame:
    """Events with an id, a type (fact if there is none) and a text (else the summary, else the name), trimmed and cut at 2000 characters."""
    have = lambda c, kind="string": F.col(c) if c in events.columns else F.lit(None).cast(kind)
    text = F.left(F.trim(F.coalesce(have("text"), have("summary"), have("name"))), F.lit(2000))
    out = events.select(have("id").alias("id"), F.coalesce(have("type"), F.lit("fact")).alias("type"), have("name").alias("name"), have("summary").alias("summary"), text.alias("text"), have("steps", "array<string>").alias("steps"), have("source_id").alias("source_id"), have("usage", "long").alias("usage"), have("attention", "double").alias("attention"))
    return out.withColumn("id", F.coalesce("id", F.concat(F.lit("know_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))))


def mental_models(rows: DataFrame, namespace: str, scope: str | None = None) -> DataFrame:
    """(id, title, query, answer) of models from title, query and answer, or from a text alone: its first line is title and query, the whole the answer.

    The id is a hash of partition, title and query, so that a model that is put again replaces itself.
    """
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    title = F.coalesce(have("title"), T.title(F.coalesce(have("text"), F.lit("")), F.lit("mental model")))
    out = rows.withColumns({"title": title, "answer": F.coalesce(have("answer"), have("text"))}).withColumn("query", F.coalesce(have("query"), F.col("title")))
    content = F.concat_ws("\x1f", F.lit(namespace), F.coalesce(F.lit(scope), F.lit("-")), "title", "query")
    return out.withColumn("id", F.concat(F.lit("mm_"), F.substring(F.sha2(content, 256), 1, 24)))


def recipes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Action recipes of rows (memory_id, text, and perhaps language and intent), and the edges that attach them; recipes are data and never run."""
    have = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in rows.columns else F.lit(other).cast("string")
    rows = rows.filter(F.trim("text") != "")
    content = F.concat_ws("\x1f", "memory_id", "text")
    made = rows.select(F.concat(F.lit("act_"), F.substring(F.sha2(content, 256), 1, 24)).alias("id"), "memory_id", have("language", "text").alias("language"), "text", have("intent", None).alias("intent"), F.lit("stored").alias("status"))
    return made, made.select(F.col("memory_id").alias("source_id"), F.lit("attached_action").alias("relation"), F.col("id").alias("target_id"), F.lit(1.0).alias("weight"))
