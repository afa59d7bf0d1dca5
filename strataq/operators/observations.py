"""Evidence grouped into observations with confidence, trend and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataq.functions import text as T


def confidence(base: Column, proofs: Column, against: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.98), base + proofs * 0.12 - against * 0.1))


def trend(proofs: Column, against: Column) -> Column:
    return F.when((against == 0) & (proofs >= 2), "strengthening").when(against > 0, "weakening").otherwise("stable")


def state(proofs: Column, against: Column) -> Column:
    return F.when(against > proofs, "contradicted").when(proofs >= 2, "promoted").otherwise("candidate")


def fact_observations(facts: DataFrame, base: float = 0.75) -> DataFrame:
    """One row per (fact_key, value).  What contradicts a value is the key's other rows: the key's count less its own."""
    own = facts.groupBy("fact_key", "subject", "attribute", "value").agg(F.count(F.lit(1)).alias("proof_count"), F.min("id").alias("first_id"))
    total = facts.groupBy("fact_key").agg(F.count(F.lit(1)).alias("_all"))
    rows = own.join(total, "fact_key").withColumn("contradiction_count", F.col("_all") - F.col("proof_count")).drop("_all")
    p, c = F.col("proof_count"), F.col("contradiction_count")
    rows = rows.withColumn("statement", F.concat("subject", F.lit(" "), "attribute", F.lit(" is "), "value"))
    return rows.withColumns({"confidence": confidence(F.lit(base), p, c), "trend": trend(p, c), "state": state(p, c), "against_as": F.when(c == 0, F.lit(None)).when(c > p, "contradicts").otherwise("weakens")})


def typed_observations(claims: DataFrame) -> DataFrame:
    """One row per (type, statement); the base confidence is the highest of its claims."""
    rows = claims.groupBy("type", "statement").agg(F.count(F.lit(1)).alias("proof_count"), F.max("confidence").alias("_base"), F.min("id").alias("first_id"))
    p, none = F.col("proof_count"), F.lit(0)
    return rows.withColumns({"confidence": confidence(F.col("_base"), p, none), "trend": trend(p, none), "state": state(p, none)}).drop("_base")


def verified(observations: DataFrame, checks: DataFrame, delta: float = 0.08, block: int = 100_000) -> DataFrame:
    """Applies verification events (key, seq, relation) in order: counts, clamped confidence, trend of the last one, state.

    Moves of a block of the sequence make one map, x to least(hi, greatest(lo, x + by)),
    so no task holds a key's whole history.
    """
    change = F.when(F.col("relation") == "supports", delta).when(F.col("relation") == "weakens", -delta).when(F.col("relation") == "contradicts", -2 * delta).otherwise(0.0)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(0.98), x))
    step = lambda m, x: F.struct((m["by"] + x).alias("by"), clamp(m["lo"] + x).alias("lo"), clamp(m["hi"] + x).alias("hi"))
    same = F.struct(F.lit(0.0).alias("by"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    blocks = checks.groupBy("key", F.floor(F.col("seq") / block).alias("_b")).agg(
        F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("seq", change.alias("by")))), lambda x: x["by"]), same, step).alias("_map"),
        F.count_if(F.col("relation") == "supports").alias("_p"),
        F.count_if(F.col("relation").isin("weakens", "contradicts")).alias("_c"),
        F.max_by("relation", "seq").alias("_last"),
    )
    agg = blocks.groupBy("key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_b", "_map"))), lambda x: x["_map"]).alias("_maps"),
        F.sum("_p").alias("_p"),
        F.sum("_c").alias("_c"),
        F.max_by("_last", "_b").alias("_last"),
    )
    rows = observations.join(agg, "key")
    apply = lambda a, m: F.least(m["hi"], F.greatest(m["lo"], a + m["by"]))
    p, c = F.col("proof_count") + F.col("_p"), F.col("contradiction_count") + F.col("_c")
    last = F.when(F.col("_last") == "supports", "strengthening").when(F.col("_last") == "weakens", "weakening").when(F.col("_last") == "contradicts", "contradicted").otherwise("stable")
    return rows.select("key", p.alias("proof_count"), c.alias("contradiction_count"), F.aggregate("_maps", F.col("confidence").cast("double"), apply).alias("confidence"), last.alias("trend"), state(p, c).alias("state"))


def packet_confidence(n: Column) -> Column:
    return F.least(F.lit(1.0), n / 5)


def reflection_confidence(models: Column, observations: Column, memories: Column) -> Column:
    return F.when(models > 0, 0.9).when(observations > 0, F.least(F.lit(0.85), 0.4 + observations * 0.1)).when(memories > 0, F.least(F.lit(0.7), 0.25 + memories * 0.08)).otherwise(0.0)


def overlap(statement: Column, cue: str) -> Column:
    """Two for each keyword and three for each name, whatever its case, that a statement shares with a cue."""
    low = lambda xs: F.transform(xs, F.lower)
    keys = F.size(F.array_intersect(T.keywords(statement, 2), T.keywords(F.lit(cue), 2)))
    names = F.size(F.array_intersect(F.array_distinct(low(T.entities(statement))), F.array_distinct(low(T.entities(F.lit(cue))))))
    return 2 * keys + 3 * names
