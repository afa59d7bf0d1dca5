"""Graph fragments of texts: entities, events, times, values and the relations between them.

A text's whole fragment is worked out in its own row, as arrays, so that joining its
parts needs no shuffle.  Local ids are content hashes; equal parts of one text are one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from strataq.functions import text as T

# Kinds, attentions and confidences of extracted memories.
ATTENTION = {"memory_entity": 1.6, "memory_event": 1.8, "memory_time": 1.4, "memory_value": 1.4}
ENTITY_SURE, TIME_SURE, VALUE_SURE, EVENT_SURE = 0.55, 0.72, 0.65, 0.62
OBSERVED, ACTOR, FIELD, OWNED = 0.6, 1.0, 0.9, 0.9

NODE = "array<struct<local_id:string,kind:string,text:string,canonical:string,value_kind:string,value:string,display:string,entity:string,sensitive:boolean,confidence:double>>"
EDGE = "array<struct<source:string,relation:string,target:string,weight:double>>"
ROOT = "root"


def local_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.lower(value), 256), 1, 16))


def entity_id(name: Column) -> Column:
    return local_id("entity", F.lower(F.trim(name)))


def _node(id_: Column, kind: str, text: Column, sure: float, canonical=None, value_kind=None, value=None, display=None, entity=None, sensitive=False) -> Column:
    s = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(
        id_.alias("local_id"), F.lit(kind).alias("kind"), text.alias("text"), s(canonical).alias("canonical"), s(value_kind).alias("value_kind"), s(value).alias("value"), s(display).alias("display"),
        s(entity).alias("entity"), (F.lit(sensitive) if isinstance(sensitive, bool) else sensitive).alias("sensitive"), F.lit(sure).alias("confidence"),
    )


def _value(kind: Column | str, raw: Column, owner: Column, mode: str, phone: bool = False) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    shown = T.phone_display(raw, mode) if phone else raw
    id_ = local_id("value", F.concat(kind, F.lit(":"), raw, F.lit(":"), F.coalesce(owner, F.lit(""))))
    stored = F.lit(None).cast("string") if phone and mode != "raw" else raw
    return _node(id_, "memory_value", F.concat(F.lit("Value: "), kind, F.lit(" "), shown), VALUE_SURE, value_kind=kind, value=stored, display=shown, entity=owner, sensitive=phone)


def _distinct(nodes: Column) -> Column:
    """The first node of each local id."""
    return F.filter(nodes, lambda x, i: F.array_position(F.transform(nodes, lambda y: y["local_id"]), x["local_id"]) == i + 1)


def extracted(docs: DataFrame, text: str = "text", structured: str | None = None, mode: str = "classify") -> DataFrame:
    """Adds ``nodes`` and ``links`` to rows with a text, and perhaps a column with the JSON of a structured input.

    ``mode`` says what becomes of phone numbers: classify (shown redacted, not stored),
    raw, or skip.  A null text has no fragment.
    """
    if mode not in ("classify", "raw", "skip"):
        raise ValueError(f"unknown mode {mode!r}")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_names", T.names(t)).withColumn("_pairs", T.flat_pairs(F.col(structured)) if structured else F.array().cast("array<struct<key:string,value:string>>"))
    of = lambda keys: F.transform(F.filter("_pairs", lambda p: p["key"].isin(*keys)), lambda p: p["value"])
    rows = rows.withColumn("_names", F.concat("_names", of(T.ENTITY_KEYS))).withColumn("_times", F.concat(T.iso_dates(t), T.month_dates(t), of(T.TIME_KEYS)))
    sole = lambda names: F.when(F.size(names) == 1, entity_id(F.get(names, F.lit(0))))
    rows = rows.withColumn("_sole", sole(F.col("_names"))).withColumn("_own", sole(of(T.ENTITY_KEYS)))
    none, sole_, own = F.array().cast(NODE), F.col("_sole"), F.col("_own")
    near = lambda x: F.coalesce(F.when(T.nearby_name(t, x).isNotNull(), entity_id(T.nearby_name(t, x))), sole_)
    values = [
        none if mode == "skip" else F.transform(T.phones(t), lambda x: _value("phone", x, near(x), mode, True)),
        F.transform(T.emails(t), lambda x: _value("email", x, sole_, mode)),
        F.transform(T.ages(t), lambda a: _value("age", a["age"], entity_id(a["name"]), mode)),
        F.transform(T.plain_numbers(t), lambda x: _value("number", x, sole_, mode)),
        F.transform(F.filter("_pairs", lambda p: p["key"].isin(*T.VALUE_KEYS, "email")), lambda p: _value(p["key"], p["value"], own, mode)),
        none if mode == "skip" else F.transform(F.filter("_pairs", lambda p: p["key"].isin(*T.PHONE_KEYS)), lambda p: _value("phone", p["value"], own, mode, True)),
    ]
    first_time = F.when(F.size("_times") > 0, local_id("time", F.get("_times", F.lit(0))))
    # A made-up relation of the parts of each phrase; an object that isn't there is no entity.
    said = F.transform(T.events(t), lambda e: F.struct(e["actor"].alias("actor"), e["action"].alias("action"), F.nullif(e["object"], F.lit("")).alias("object")))
    event_id = lambda e: local_id("event", F.concat_ws(":", e["actor"], e["action"], F.coalesce(e["object"], F.lit("")), F.coalesce(first_time, F.lit(""))))
    rows = rows.withColumn("_events", said)
    nodes = F.concat(
        F.transform("_names", lambda x: _node(entity_id(x), "memory_entity", F.concat(F.lit("Entity: "), x), ENTITY_SURE, canonical=F.lower(F.trim(x)))),
        F.transform("_events", lambda e: _node(event_id(e), "memory_event", F.concat(F.lit("Event: "), F.concat_ws(" ", e["actor"], e["action"], e["object"])), EVENT_SURE)),
        F.transform("_times", lambda x: _node(local_id("time", x), "memory_time", F.concat(F.lit("Time: "), x), TIME_SURE, value=x)),
        *[v.cast(NODE) for v in values],
    )
    link = lambda s, r, o, w: F.struct(s.alias("source"), F.lit(r).alias("relation"), o.alias("target"), F.lit(w).alias("weight"))
    rows = rows.withColumn("nodes", T.bound(nodes.cast(NODE), _distinct))
    links = F.concat(
        F.flatten(F.transform("_events", lambda e: F.array(link(event_id(e), "actor", entity_id(e["actor"]), ACTOR), link(event_id(e), "acted_on", entity_id(e["object"]), FIELD), link(event_id(e), "happened_at", first_time, FIELD)))).cast(EDGE),
        F.transform(F.filter("nodes", lambda n: n["kind"] == "memory_value"), lambda n: link(F.coalesce(n["entity"], sole_), "has_value", n["local_id"], OWNED)).cast(EDGE),
    )
    rows = rows.withColumn("links", whole_links(links, F.col("nodes")))
    return rows.drop("_names", "_pairs", "_times", "_sole", "_own", "_events")


def whole_links(links: Column, nodes: Column) -> Column:
    """Links whose ends are both nodes, each once."""
    ids = F.transform(nodes, lambda n: n["local_id"])
    whole = T.bound(ids, lambda own: F.filter(links, lambda x: F.array_contains(own, x["source"]) & F.array_contains(own, x["target"])))
    return F.array_distinct(whole)


def allowed(relation: Column) -> Column:
    """A relation of the list, or related_to."""
    return F.when(F.trim(relation).isin(*T.RELATIONS), F.trim(relation)).otherwise("related_to")


def with_adapter(rows: DataFrame, adapter: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """Adds what an adapter finds, as rows (key, nodes, links), to the fragments; relations that aren't on the list become related_to.

    An adapter that fails adds nothing.
    """
    try:
        more = adapter(rows.select(key, "text")).select(key, F.col("nodes").cast(NODE).alias("_n"), F.transform("links", lambda x: F.struct(x["source"].alias("source"), allowed(x["relation"]).alias("relation"), x["target"].alias("target"), F.coalesce(x["weight"], F.lit(1.0)).alias("weight"))).cast(EDGE).alias("_l"))
    except Exception:  # an adapter is user code, and what it finds is an extra
        return rows
    out = rows.join(more, key, "left")
    nodes = T.bound(F.concat("nodes", F.coalesce("_n", F.array().cast(NODE))), _distinct)
    out = out.withColumn("nodes", nodes)
    return out.withColumn("links", whole_links(F.concat("links", F.coalesce("_l", F.array().cast(EDGE))), F.col("nodes"))).drop("_n", "_l")


def graph_edges(nodes: Column, links: Column) -> Column:
    """array of (source, relation, target, weight): what was seen in the text, what the text mentions, and the links."""
    seen = F.transform(nodes, lambda n: F.struct(n["local_id"].alias("source"), F.lit("observed_in").alias("relation"), F.lit(ROOT).alias("target"), F.lit(OBSERVED).alias("weight")))
    said = F.transform(F.filter(nodes, lambda n: n["kind"] == "memory_entity"), lambda n: F.struct(F.lit(ROOT).alias("source"), F.lit("mentions_entity").alias("relation"), n["local_id"].alias("target"), n["confidence"].alias("weight")))
    return F.concat(seen.cast(EDGE), said.cast(EDGE), links)
