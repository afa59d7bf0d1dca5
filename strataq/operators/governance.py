"""Lifecycle states and facts as ordered folds.

A fold over an ordered history is cut into blocks of the sequence.  Each block is
reduced to a map from the state before it to the state after it; a memory's blocks
are then applied in order.  So no task holds one memory's whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strataq.functions.predicates import STATES, goes


def latest_state(events: DataFrame) -> DataFrame:
    """The state written last, legal or not."""
    return events.groupBy("memory_id").agg(F.max_by("state", "seq").alias("state"))


def folded_state(events: DataFrame, block: int = 100_000) -> DataFrame:
    """(memory_id, state) after all legal moves in order; illegal ones are skipped."""
    step = lambda s, x: F.when(goes(s, x), x).otherwise(s)
    before = F.array(F.lit(None).cast("string"), *[F.lit(s) for s in STATES])
    blocks = events.groupBy("memory_id", F.floor(F.col("seq") / block).alias("_b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "state"))), lambda x: x["state"]).alias("_moves"))
    blocks = blocks.select("memory_id", "_b", F.transform(before, lambda s: F.aggregate("_moves", s, step)).alias("_after"))
    place = lambda s: F.coalesce(F.array_position(before, s), F.lit(1)).cast("int")
    return blocks.groupBy("memory_id").agg(
        F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_after"))), lambda x: x["_after"]), F.lit(None).cast("string"), lambda s, after: F.element_at(after, place(s))).alias("state")
    )


def fact_events(facts: DataFrame, block: int = 1_000_000) -> DataFrame:
    """What each statement of a fact does, where no fact is pinned: observed, verified, or replaced with the memory it contradicts.

    A statement is compared with the one before it; the first of a block of ids with the
    last of the blocks before, so that no task sorts one fact's whole history.
    """
    w, b = Window.partitionBy("fact_key", "_b").orderBy("id"), Window.partitionBy("fact_key").orderBy("_b")
    rows = facts.withColumn("_b", F.floor(F.col("id") / block))
    ends = rows.groupBy("fact_key", "_b").agg(F.max_by(F.struct("value", "id"), "id").alias("_end"))
    ends = ends.select("fact_key", "_b", F.lag("_end").over(b).alias("_prior"))
    out = rows.join(ends, ["fact_key", "_b"]).withColumn("_before", F.coalesce(F.lag(F.struct("value", "id")).over(w), "_prior"))
    before, value = F.col("_before.value"), F.col("value")
    reason = F.when(before.isNull(), "fact_observed").when(before == value, "fact_verified").otherwise("fact_replaced_previous")
    out = out.withColumn("reason", reason).withColumn("contradicts", F.when(F.col("reason") == "fact_replaced_previous", F.col("_before.id")))
    return out.drop("_b", "_prior", "_before")


GOVERNED = "fact_key string, seq long, memory_id string, value string, state string, reason string"


def govern(now: tuple | None, event: dict) -> tuple[tuple | None, list[tuple]]:
    """One step of a fact: the memory, value and state that hold it, and an event; returns them anew, and the states to write.

    A statement is observed, verified, held back by a pinned fact, or replaces what held;
    a state event of a memory that states the fact makes it hold the fact, and a terminal
    one ends that.
    """
    me, value, state = event["memory_id"], event["value"], event["state"]
    if event["kind"] == "state":
        if state in ("contradicted", "forgotten"):
            return (None if now is not None and now[0] == me else now), []
        return (me, value, state), []
    if now is None or now[1] == value:
        return (me, value, state), [(me, value, state, "fact_observed" if now is None else "fact_verified")]
    if now[2] == "pinned":
        return now, [(me, value, "candidate", "conflicts_with_pinned_fact")]
    return (me, value, "promoted"), [(now[0], now[1], "contradicted", "replaced_by_newer_fact"), (me, value, "promoted", "fact_replaced_previous")]


def governed_facts(events: DataFrame) -> DataFrame:
    """(fact_key, seq, memory_id, value, state, reason) of the states that statements and state events lead to, in order.

    ``events`` has fact_key, seq, kind (claim or state), memory_id, value and state.  Each
    step depends on the one before, whatever that was, so a fact's events pass through
    one task, which holds one event and one state of the fact at a time.
    """

    def run(batches):
        import pyarrow as pa

        key, now = None, None
        for b in batches:
            out = []
            for e in b.to_pylist():
                if e["fact_key"] != key:
                    key, now = e["fact_key"], None
                now, made = govern(now, e)
                out += [(key, e["seq"], *m) for m in made]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            names = [c.split()[0] for c in GOVERNED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "seq" else pa.string()) for n, c in zip(names, cols, strict=True)], names)

    rows = events.select("fact_key", "seq", "kind", "memory_id", "value", "state").filter(F.col("fact_key").isNotNull())
    return rows.repartition("fact_key").sortWithinPartitions("fact_key", "seq").mapInArrow(run, GOVERNED)


def current_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("fact_key").agg(F.max_by("value", "id").alias("value"), F.max("id").alias("id"))


def stale(states: DataFrame, cutoff) -> DataFrame:
    """Fact states that decay: not pinned, stale or terminal, last verified (else observed, else inserted) strictly before the cutoff."""
    at = F.coalesce("last_verified", "observed", "inserted")
    return states.filter(F.col("fact_key").isNotNull() & ~F.coalesce(F.col("state"), F.lit("")).isin("pinned", "stale", "contradicted", "forgotten") & (at < F.lit(cutoff)))
