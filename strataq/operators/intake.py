"""Documents taken in: chunks, summaries, categories, extracted parts, and the links between them.

Everything of one document is worked out in its own row; only links to other documents
need joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataq.functions import text as T
from strataq.operators import extraction as X
from strataq.operators.linking import candidates

# Attentions of the rows of an intake, and weights and limits of its links.
ATTENTION = {"root": 2.0, "chunk": 1.0, "summary": 1.5, "category": 1.1}
CATEGORY_WEIGHT, CROSS_LEAST, CROSS_MOST = 0.8, 0.24, 20


def shared_terms(items: DataFrame, within: list[str]) -> DataFrame:
    """Pairs (a < b) of items of one group that share a term, with the number shared; items have id, terms, and the group's columns.

    Only pairs with a common term are made: an equi-join on the term inside the group.
    """
    t = items.select(*within, "id", F.explode("terms").alias("_t"))
    left, right = t.withColumnRenamed("id", "a"), t.withColumnRenamed("id", "b")
    return left.join(right, [*within, "_t"]).filter("a < b").groupBy(*within, "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def related(chunks: Column, least: float = 0.18, most: int = 40) -> Column:
    """Of an array of (id, terms): array of struct(a, b, weight) of the pairs with Jaccard similarity of at least ``least``, the strongest ``most`` first.

    All chunks of a text lie in one row, so that nothing is shuffled; of each chunk's
    pairs only the strongest ``most`` are held.
    """
    first = lambda pairs: F.slice(F.sort_array(pairs), 1, most)

    def pair(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x["terms"], y["terms"]))
        less = T.bound(shared, lambda s: -F.round(s / F.greatest(F.lit(1), F.size(x["terms"]) + F.size(y["terms"]) - s), 6))
        return F.struct(less.alias("less"), x["id"].alias("a"), y["id"].alias("b"))

    def of(x: Column, i: Column) -> Column:
        later = F.slice(chunks, i + 2, F.size(chunks))
        return first(F.filter(F.transform(later, lambda y: pair(x, y)), lambda p: p["less"] <= -least))

    best = first(F.flatten(F.transform(chunks, of)))
    return F.transform(best, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), (-p["less"]).alias("weight")))


def relationship(keywords: Column, entities: Column, categories: Column, same_task: Column) -> Column:
    """min(1, max(keyword, entity) + categories / 4 + 0.12 for the same task)."""
    return F.least(F.lit(1.0), F.greatest(keywords, entities) + 0.25 * categories + F.when(same_task, 0.12).otherwise(0.0))


def same_entity(nodes: DataFrame) -> DataFrame:
    """Edges between an entity's first node and its later ones, by canonical name: as connected as all pairs, without their number.

    The first node is an aggregate with map-side combining, and adaptive execution can
    split the join, so that a name in many nodes fills no task.
    """
    first = nodes.groupBy("canonical").agg(F.min("id").alias("source_id"))
    return nodes.join(first, "canonical").filter(F.col("id") > F.col("source_id")).select("canonical", "source_id", F.col("id").alias("target_id"))


def packets(docs: DataFrame, size: int = 180, overlap: int = 40, extract: bool = True, mode: str = "classify") -> DataFrame:
    """Of (id, text) and other columns: what each document comes to, in one row.

    Adds kind, stream, title, chunks (index, text, categories, terms, summary), brief (the
    summary of the chunks' summaries), labels, and the nodes and links of its fragment.
    Documents without text are dropped.
    """
    rows = docs.filter(F.trim("text") != "").withColumn("id", F.col("id").cast("string"))
    kind = T.kind(F.col("text"))
    rows = rows.withColumn("kind", kind).withColumn("stream", T.stream_of(F.col("kind"))).withColumn("title", T.title(F.col("text"), F.col("kind")))

    def chunk(c: Column, i: Column) -> Column:
        body = lambda own: F.struct((i + 1).cast("long").alias("index"), own.alias("text"), T.chunk_categories(own).alias("categories"), T.keywords(own).alias("terms"), F.array_join(F.slice(c["words"], 1, 36), " ").alias("summary"))
        return T.bound(F.array_join(c["words"], " "), body)

    rows = rows.withColumn("chunks", F.transform(T.chunks(F.col("text"), size, overlap), chunk))
    rows = rows.withColumn("brief", T.summary(F.array_join(F.transform("chunks", lambda c: c["summary"]), "\n")))
    found = F.concat(F.flatten(F.transform("chunks", lambda c: c["categories"])), F.flatten(F.transform("chunks", lambda c: T.categories(c["summary"]))), T.categories(F.col("brief")), F.array("kind"))
    rows = rows.withColumn("labels", F.array_distinct(found))
    if extract:
        return X.extracted(rows, mode=mode)
    return rows.withColumn("nodes", F.array().cast(X.NODE)).withColumn("links", F.array().cast(X.EDGE))


def _id(*parts: Column | str) -> Column:
    return F.concat_ws("/", F.col("id"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def memories(rows: DataFrame) -> DataFrame:
    """(id, root_id, role, kind, text, title, categories, attention, canonical, value_kind, value, display) of all that packets come to."""
    none, labels = F.lit(None).cast("string"), F.array().cast("array<string>")

    def row(id_: Column, role: str, kind: Column, text: Column, categories: Column, attention: Column, title: Column = none, extra: tuple = (none,) * 4) -> Column:
        names = ("canonical", "value_kind", "value", "display")
        return F.struct(id_.alias("id"), F.lit(role).alias("role"), kind.alias("kind"), text.alias("text"), title.alias("title"), categories.alias("categories"), attention.cast("double").alias("attention"), *[x.alias(n) for x, n in zip(extra, names, strict=True)])

    weight = lambda role: F.lit(ATTENTION[role])
    extracted = F.create_map(*[F.lit(x) for kv in X.ATTENTION.items() for x in kv])
    parts = F.concat(
        F.array(row(F.col("id"), "root", F.col("kind"), F.col("text"), labels, weight("root"), F.col("title"))),
        F.transform("chunks", lambda c: row(_id("chunk", c["index"].cast("string")), "chunk", F.lit("memory_chunk"), c["text"], c["categories"], weight("chunk"))),
        F.transform("chunks", lambda c: row(_id("summary", c["index"].cast("string")), "summary", F.lit("memory_summary"), c["summary"], T.categories(c["summary"]), weight("summary"), F.col("title"))),
        F.array(row(_id("summary", "root"), "summary", F.lit("memory_summary"), F.col("brief"), T.categories(F.col("brief")), weight("summary"), F.col("title"))),
        F.transform("labels", lambda x: row(_id("category", x), "category", F.lit("memory_category"), F.concat(F.lit("Category: "), x), F.array(x), weight("category"))),
        F.transform("nodes", lambda n: row(_id(n["local_id"]), "extracted_fact", n["kind"], n["text"], F.array(F.replace(n["kind"], F.lit("memory_"), F.lit(""))), extracted[n["kind"]], none, (n["canonical"], n["value_kind"], n["value"], n["display"]))),
    )
    return rows.select(F.col("id").alias("root_id"), F.inline(parts))


def links(rows: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, relation, target_id, weight) of the links inside each packet; of some relations only, if they are named."""

    def link(s: Column, r: str, t: Column, w: Column | float = 1.0) -> Column:
        return F.struct(s.alias("source_id"), F.lit(r).alias("relation"), t.alias("target_id"), (F.lit(w) if isinstance(w, float) else w).alias("weight"))

    me, chunk, brief = F.col("id"), lambda c: _id("chunk", c["index"].cast("string")), lambda c: _id("summary", c["index"].cast("string"))
    filed = lambda at, labels: F.transform(labels, lambda x: link(at, "categorized_as", _id("category", x), CATEGORY_WEIGHT))
    later = F.slice("chunks", F.lit(2), F.greatest(F.size("chunks"), F.lit(1)))
    alike = T.bound(F.transform("chunks", lambda c: F.struct(c["index"].alias("id"), c["terms"].alias("terms"))), lambda c: related(c))
    at = lambda x: F.when(x == X.ROOT, me).otherwise(_id(x))
    parts = {
        "contains_chunk": F.transform("chunks", lambda c: link(me, "contains_chunk", chunk(c))),
        "has_summary": F.concat(F.transform("chunks", lambda c: link(me, "has_summary", brief(c))), F.array(link(me, "has_summary", _id("summary", "root"))), F.transform("chunks", lambda c: link(chunk(c), "has_summary", brief(c)))),
        "summarizes": F.transform("chunks", lambda c: link(brief(c), "summarizes", chunk(c))),
        "has_category": F.transform("labels", lambda x: link(me, "has_category", _id("category", x))),
        "next_chunk": F.transform(later, lambda c: link(_id("chunk", (c["index"] - 1).cast("string")), "next_chunk", chunk(c))),
        "previous_chunk": F.transform(later, lambda c: link(chunk(c), "previous_chunk", _id("chunk", (c["index"] - 1).cast("string")))),
        "categorized_as": F.concat(F.flatten(F.transform("chunks", lambda c: F.concat(filed(chunk(c), c["categories"]), filed(brief(c), T.categories(c["summary"]))))), filed(_id("summary", "root"), T.categories(F.col("brief")))),
        "related_chunk": F.transform(alike, lambda p: link(_id("chunk", p["a"].cast("string")), "related_chunk", _id("chunk", p["b"].cast("string")), p["weight"])),
        "extracted": F.transform(X.graph_edges(F.col("nodes"), F.col("links")), lambda x: F.struct(at(x["source"]).alias("source_id"), x["relation"].alias("relation"), at(x["target"]).alias("target_id"), x["weight"].alias("weight"))),
    }
    return rows.select(F.inline(F.concat(*[p for name, p in parts.items() if not relations or name in relations])))


def anchors(rows: DataFrame) -> DataFrame:
    """(id, root_id, task_id, keywords, entities, categories) of roots and chunks, which may be linked to other memories."""
    m = memories(rows).filter(F.col("role").isin("root", "chunk"))
    return m.select("id", "root_id", F.lit(None).cast("string").alias("task_id"), T.keywords(F.col("text")).alias("keywords"), T.entities(F.col("text")).alias("entities"), "categories")


def cross_links(anchors_: DataFrame, others: DataFrame, existing: DataFrame | None = None, least: float = CROSS_LEAST, most: int = CROSS_MOST) -> DataFrame:
    """(root_id, source_id, target_id, weight): the strongest ``most`` links of each root's anchors to other memories.

    Both sides have id, root_id, task_id, keywords, entities and categories.  Only pairs
    with a keyword, an entity or a category in common count; a pair that shares none has
    a score of 0.12 at most, which is below ``least``.  Pairs that ``existing`` links
    (source_id, target_id) in either direction are left out.  Pairs are never listed: each
    block of other memories gives an anchor's strongest ones from its index lists.
    """
    gone = None
    if existing is not None:
        gone = existing.select("source_id", "target_id").unionByName(existing.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    rows = candidates(anchors_, others, gone, least, most)
    part = lambda c: F.col(f"_shared_{c}") / F.greatest(F.lit(1), F.col(f"_sizes_{c}") - F.col(f"_shared_{c}"))
    score = relationship(part("keywords"), part("entities"), part("categories"), F.col("_same"))
    rows = rows.select("root_id", "source_id", "target_id", F.round(score, 6).alias("weight")).filter(F.col("weight") >= least)
    w = Window.partitionBy("root_id").orderBy(F.desc("weight"), "source_id", "target_id")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def turns(rows: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """One text for each exchange: its turns in order, a line each, with their number; blank turns are left out."""
    held = rows.filter(F.trim(text) != "").groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("_t")))).alias("_turns"))
    return held.select(by, F.array_join(F.transform("_turns", lambda x: x["_t"]), "\n").alias("text"), F.size("_turns").cast("long").alias("turns"))


def recent_context(rows: DataFrame, most: int = 12) -> DataFrame:
    """Adds ``recent``: the ids of the newest ``most`` earlier memories of the same stream or task, the newest first; rows have id, seq, stream and task_id."""

    def before(by: str) -> Column:
        w = Window.partitionBy(by).orderBy("seq").rowsBetween(-most, -1)
        return F.when(F.col(by).isNotNull(), F.collect_list(F.struct("seq", "id")).over(w)).otherwise(F.array())

    both = rows.withColumn("_s", before("stream")).withColumn("_t", before("task_id"))
    newest = F.slice(F.reverse(F.sort_array(F.array_union("_s", "_t"))), 1, most)
    return both.withColumn("recent", F.transform(newest, lambda x: x["id"])).drop("_s", "_t")
