"""Forgetting: what a selector names, and all that refers to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strataq.operators import graph as R

# The fields by which a record refers to others.
REFERENCES = ("id", "source_id", "memory_id", "signal_id", "target_id")
REFERENCE_LISTS = ("source_ids", "metadata.provenance.source_ids")


def selected(moments: DataFrame, selector) -> DataFrame:
    """Moments by (stream, name), (task, id), an id of theirs or of their signal, or any test of their columns."""
    if isinstance(selector, tuple) and len(selector) == 2 and selector[0] in ("stream", "task"):
        return moments.filter(F.col("stream" if selector[0] == "stream" else "task_id") == selector[1])
    if isinstance(selector, str):
        return moments.filter((F.col("id") == selector) | (F.col("signal_id") == selector))
    if isinstance(selector, Column):
        return moments.filter(selector)
    raise ValueError("a selector is an id, a stream, a task or a test")


def references(payload: Column) -> Column:
    """array of the ids that a JSON payload refers to, its own among them."""
    one = [F.get_json_object(payload, f"$.{f}") for f in REFERENCES]
    many = [F.coalesce(F.from_json(F.get_json_object(payload, f"$.{f}"), "array<string>"), F.array().cast("array<string>")) for f in REFERENCE_LISTS]
    return F.array_distinct(F.concat(F.array_compact(F.array(*one)), *many))


def targets(hit: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """(family, id) of all that goes with some moments: they, their signals, edges, recipes, and every record that refers to them.

    ``hit`` has id and signal_id, ``edges`` id, source_id, relation and target_id, and
    ``records`` family, id and payload; tombstones and states of memories stay.
    """
    grave = lambda df, family, id_: df.select(F.lit(family).alias("family"), F.col(id_).alias("id"))
    ids = hit.select(F.col("id").alias("node"))
    touched = R.incident(edges, ids)
    recipes = edges.filter("relation = 'attached_action'").join(ids.withColumnRenamed("node", "source_id"), "source_id", "left_semi")
    known = hit.select(F.explode(F.array_compact(F.array("id", "signal_id"))).alias("ref")).distinct()
    open_ = records.filter(~F.col("family").isin("tombstones", "memory_states")).select("family", "id", F.explode(F.array_union(F.array("id"), references(F.col("payload")))).alias("ref"))
    referring = open_.join(known, "ref", "left_semi").select("family", "id")
    explicit = grave(hit, "moments", "id").unionByName(grave(hit, "signals", "signal_id").filter("id IS NOT NULL")).unionByName(grave(touched, "associations", "id")).unionByName(grave(recipes, "action_recipes", "target_id"))
    return explicit.unionByName(referring).distinct()
