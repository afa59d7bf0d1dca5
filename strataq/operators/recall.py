"""Recall: structured scores, graph neighbours, what belongs to memories, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataq.functions import text as T
from strataq.operators import graph as R
from strataq.operators import retrieval as Q

# How far a budget lets recall reach, floors of structured memories, and the order of observations.
BUDGETS = {"low": (1, 1), "mid": (2, 2), "high": (4, 3)}
CANONICAL, ALIAS, EVENT, TIME, VALUE = 7, 6, 5, 3, 3
OBSERVATION_ORDER = ("decision", "preference", "project_state", "pattern", "fact")


def budget(level: str) -> tuple[int, int]:
    """How many times the limit seeds may be, and how many steps the graph is followed."""
    if level not in BUDGETS:
        raise ValueError(f"unknown budget {level!r}")
    return BUDGETS[level]


def structured_score(cue: str, kind: Column, text: Column, attention: Column, canonical: Column, aliases: Column | None = None) -> Column:
    """What an extracted memory is worth to a cue: an entity that it names, an event or time that it asks for, a value that it asks for; else 0."""
    low = F.lit(cue.lower())
    keys = Q.cue_terms(cue, 3)
    overlaps = F.size(F.array_intersect(T.keywords(text), F.array(*[F.lit(k) for k in keys]))) > 0 if keys else F.lit(False)
    named = F.coalesce(F.contains(low, canonical), F.lit(False))
    other = F.coalesce(F.exists(aliases, lambda a: F.contains(low, F.lower(a))), F.lit(False)) if aliases is not None else F.lit(False)
    when, event, value = (F.lit(x) for x in (T.asks(cue, T.ASKS_WHEN), T.asks(cue, T.ASKS_WHEN) or T.asks(cue, T.ASKS_ACTION), T.asks(cue, T.ASKS_VALUE)))
    out = F.when((kind == "memory_entity") & named, CANONICAL + attention).when((kind == "memory_entity") & other, ALIAS + attention)
    out = out.when((kind == "memory_event") & event & overlaps, EVENT + attention).when((kind == "memory_time") & when, TIME + attention)
    return F.coalesce(out.when((kind == "memory_value") & value, VALUE + attention), F.lit(0.0))


def reranked(rows: DataFrame, cue: str, score: str = "score") -> DataFrame:
    """Lifts structured memories to their floor; rows have kind, text, attention, canonical and a score."""
    return rows.withColumn(score, F.greatest(F.col(score), structured_score(cue, F.col("kind"), F.col("text"), F.col("attention"), F.col("canonical"))))


def opposite(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node) at the other end of the edges that touch some nodes (column node)."""
    return R.both_ways(edges).join(ids.select("node").distinct(), "node", "left_semi").select(F.col("other").alias("node")).distinct()


def artifacts_for(edges: DataFrame, ids: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The artifacts that an edge ties to some memories."""
    return artifacts.join(opposite(edges, ids).withColumnRenamed("node", "id"), "id", "left_semi")


def recipes_for(edges: DataFrame, ids: DataFrame, recipes: DataFrame) -> DataFrame:
    """The recipes attached to some memories or to their neighbours."""
    near = ids.select("node").unionByName(opposite(edges, ids)).distinct().withColumnRenamed("node", "source_id")
    held = edges.filter("relation = 'attached_action'").join(near, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    return recipes.join(held, "id", "left_semi")


def statuses(moments: DataFrame) -> DataFrame:
    """The latest (kind, text, seq) of every stream and of every task."""
    keyed = moments.select(F.explode(F.array_compact(F.array(F.when(F.col("stream").isNotNull(), F.struct(F.lit("stream").alias("by"), F.col("stream").alias("name"))), F.when(F.col("task_id").isNotNull(), F.struct(F.lit("task").alias("by"), F.col("task_id").alias("name")))))).alias("k"), "stream", "task_id", "kind", "text", "seq")
    return keyed.groupBy("k").agg(F.max_by(F.struct("stream", "task_id", "kind", "text", "seq"), "seq").alias("r")).select("k.by", "k.name", "r.*")


def first_of(lists: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Rows of several lists, of equal keys the one of the first list, with its least rank; lists have the key's columns and a rank."""
    rows = None
    for place, x in enumerate(lists):
        x = x.withColumn("_place", F.struct(F.lit(place).alias("list"), F.col("rank").alias("rank")))
        rows = x if rows is None else rows.unionByName(x, allowMissingColumns=True)
    return rows.groupBy(*by).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in by]), "_place").alias("_r")).select(*by, "_r.*").drop("_place")


def merged(lists: Sequence[DataFrame], limit: int = 30) -> DataFrame:
    """Results of several sources as one ranking, each (source, family, id) once, by score and then id."""
    rows = None
    for x in lists:
        x = x.select("source", "family", "id", F.col("score").cast("double").alias("score"), "text")
        rows = x if rows is None else rows.unionByName(x)
    best = rows.groupBy("source", "family", "id").agg(F.max_by(F.struct("score", "text"), "score").alias("_r")).select("source", "family", "id", "_r.*")
    return Q.top(best, limit, F.desc("score"), F.col("id"), F.col("source"), F.col("family"))


def observation_rank(kind: Column) -> Column:
    out = F.lit(len(OBSERVATION_ORDER))
    for i, k in enumerate(OBSERVATION_ORDER):
        out = F.when(kind == k, i).otherwise(out)
    return out


def evidence(models: DataFrame, observations: DataFrame, moments: DataFrame) -> DataFrame:
    """(place, type, id, claim, source_ids): models, then observations by their type, then memories; each in its own order (column rank)."""
    none = F.array().cast("array<string>")
    ids = lambda df: F.coalesce(F.col("source_ids"), none) if "source_ids" in df.columns else none
    parts = [
        models.select(F.lit("mental_model").alias("type"), "id", F.col("answer").alias("claim"), ids(models).alias("source_ids"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("rank").cast("long").alias("c")).alias("_o")),
        observations.select(F.lit("observation").alias("type"), "id", F.col("statement").alias("claim"), ids(observations).alias("source_ids"), F.struct(F.lit(1).alias("a"), observation_rank(F.col("type")).alias("b"), F.col("rank").cast("long").alias("c")).alias("_o")),
        moments.select(F.lit("moment").alias("type"), "id", F.col("text").alias("claim"), F.array("id").alias("source_ids"), F.struct(F.lit(2).alias("a"), F.lit(0).alias("b"), F.col("rank").cast("long").alias("c")).alias("_o")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return Q.numbered(rows, F.col("_o.a"), F.col("_o.b"), F.col("_o.c")).withColumnRenamed("rank", "place").drop("_o")


def hit_rates(hits: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, hit_rate) of searches that should have found something (column hit, boolean)."""
    return hits.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def batch_hits(cases: DataFrame, docs: DataFrame, limit: int = 10) -> DataFrame:
    """(label, hit) of many searches at once: whether one of a cue's best ``limit`` texts holds the token.

    Cases have cue, token and label, texts are scored by the keywords that they share
    with the cue, ties by id.  Cases are few; texts meet them by an equi-join on keywords.
    """
    keyed = cases.withColumn("_case", F.xxhash64("cue", "token"))
    asked = keyed.select("_case", F.explode(T.keywords(F.col("cue"))).alias("_k"))
    had = docs.select("id", F.explode(T.keywords(F.col("text"))).alias("_k"))
    scored = had.join(F.broadcast(asked), "_k").groupBy("_case", "id").agg(F.count(F.lit(1)).alias("_n"))  # cases are few
    w = Window.partitionBy("_case").orderBy(F.desc("_n"), "id")
    best = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).join(docs, "id").select("_case", "text")
    found = keyed.select("_case", "token", "label").join(best, "_case", "left")
    return found.groupBy("_case", "label").agg(F.max(F.coalesce(F.contains("text", "token"), F.lit(False))).alias("hit")).select("label", "hit")


def usage(events: DataFrame, by: str = "type") -> DataFrame:
    """(type, events, used, tokens): how many events there are, how many were used, and their estimated tokens."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("usage") > 0).alias("used"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))
