"""Rows derived from memories by the operators of intake, consolidation, recall and forgetting."""

from __future__ import annotations

import datetime as dt
import secrets as tokens
import uuid

from pyspark.sql import Window, functions as F

from strataq.engine import Memory
from strataq.functions import text as T
from strataq.functions import vectors as V
from strataq.operators import consolidation as C
from strataq.operators import embedding as E
from strataq.operators import extraction as X
from strataq.operators import forgetting as D
from strataq.operators import governance as G
from strataq.operators import intake as I
from strataq.operators import knowledge as K
from strataq.operators import log as L
from strataq.operators import recall as A
from strataq.operators import retrieval as Q
from strataq.operators import secrets as S
from strataq.operators import temporal as W
from strataq.plans.knowledge_queries import EVENTS_SQL, RANK_SQL, events
from strataq.plans.memory_queries import ASK, CUE, EDGES_SQL, HAMMING_SQL, LOG_SQL, VEC0, bm25_sql, edges, fact_rows, log, seeds
from strataq.plans.registry import query, table
from strataq.sessions import checkpoint_folder
from strataq.sources.frames import framed, frames_of
from strataq.sources.log_store import LogStore, completed

TEXT_HASH = "substr(sha256({}), 1, 24)"


# Memories made of conversation turns: kinds by the turn, streams by the role, seven tasks.
TURNS_SQL = "(SELECT 'm' || conv_id || '-' || turn AS id, CAST(conv_id * 100 + turn AS BIGINT) AS seq, role AS stream, 'task-' || (conv_id % 7) AS task_id, CASE turn % 3 WHEN 0 THEN 'memory_summary' WHEN 1 THEN 'memory_category' ELSE 'text' END AS kind, text FROM conversations)"


def memories(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "memory_summary").when(F.col("turn") % 3 == 1, "memory_category").otherwise("text")
    return c.select(
        F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("seq"), F.col("role").alias("stream"),
        F.concat(F.lit("task-"), (F.col("conv_id") % 7).cast("string")).alias("task_id"), kind.alias("kind"), "text", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("signal_id"), "conv_id", F.lit(1.0).alias("attention"),
    )


@query("age_extract", "SELECT CAST(s_suppkey AS BIGINT) AS id, 'Supplier' || s_suppkey AS name, CAST(20 + s_suppkey % 60 AS VARCHAR) AS age FROM supplier")
def age_extract(spark, sf_dir):
    """Names with a stated age, in four languages."""
    s = table(spark, sf_dir, "supplier")
    age = (20 + F.col("s_suppkey") % 60).cast("string")
    m = F.col("s_suppkey") % 4
    said = F.when(m == 0, F.concat(F.lit(" is "), age, F.lit(" years old"))).when(m == 1, F.concat(F.lit(" ha "), age, F.lit(" anni"))).when(m == 2, F.concat(F.lit(" tiene "), age, F.lit(" años"))).otherwise(F.concat(F.lit(" âge "), age))
    text = F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string"), said)
    return s.select(F.col("s_suppkey").cast("long").alias("id"), F.inline(T.ages(text)))


@query("plain_numbers", "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(7 + s_suppkey AS VARCHAR) || '.5' AS numbers FROM supplier")
def plain_numbers(spark, sf_dir):
    """Numbers without those of ages, phones and dates."""
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("Sam is 42 years old, call +39 333 123 4567 on 2026-05-10 or 10 maggio 2026 for "), (7 + F.col("s_suppkey")).cast("string"), F.lit(".5 boxes of x"), n)
    return s.select(F.col("s_suppkey").cast("long").alias("id"), F.array_join(T.plain_numbers(text), " ").alias("numbers"))


@query("phone_redacted", "SELECT CAST(s_suppkey AS BIGINT) AS id, '[redacted phone]' AS shown, 'Ann' || s_suppkey AS owner FROM supplier")
def phone_redacted(spark, sf_dir):
    """Phone numbers give way to a mark; the last name before one owns it."""
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("Bob met us. Ann"), F.col("s_suppkey").cast("string"), F.lit(" phone: +39 333 "), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.lit(" 4567."))
    p = F.transform(T.phones(text), lambda x: F.struct(T.phone_display(x).alias("shown"), T.nearby_name(text, x).alias("owner")))
    return s.select(F.col("s_suppkey").cast("long").alias("id"), F.inline(p))


TALK = ["Thanks!", "ok", "Sounds good.", "hello world", "ship it now"]


@query("retention_policy", f"SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_partkey % 5 IN (3, 4) AND len({TALK}) = 5")
def retention_policy(spark, sf_dir):
    """What a code agent's mission keeps: all but small talk."""
    text = F.element_at(F.array(*[F.lit(t) for t in TALK]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").filter(~T.small_talk(text)).select(F.col("p_partkey").cast("long").alias("id"))


@query("structured_pairs", "SELECT CAST(s_suppkey AS BIGINT) AS id, k AS key, v AS value FROM (SELECT s_suppkey, unnest([{'k': 'name', 'v': s_name}, {'k': 'age', 'v': CAST(s_nationkey AS VARCHAR)}, {'k': 'email', 'v': 'x' || s_suppkey || '@y.org'}]) AS p FROM supplier) t, LATERAL (SELECT p.k AS k, p.v AS v)")
def structured_pairs(spark, sf_dir):
    """Keys and values of nested structured inputs."""
    s = table(spark, sf_dir, "supplier")
    doc = F.to_json(F.struct(F.col("s_name").alias("Name"), F.struct(F.col("s_nationkey").alias("AGE"), F.struct(F.concat(F.lit("x"), F.col("s_suppkey").cast("string"), F.lit("@y.org")).alias("email")).alias("inner")).alias("more")))
    return s.select(F.col("s_suppkey").cast("long").alias("id"), F.inline(T.flat_pairs(doc)))


E_SQL = "'entity:' || substr(sha256(lower({})), 1, 16)"
GRAPH_SQL = f"""WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS id, replace(n_name, ' ', '_') AS who, replace(r_name, ' ', '_') AS whom, '2026-' || lpad(CAST(1 + n_nationkey % 12 AS VARCHAR), 2, '0') || '-10' AS day FROM nation JOIN region ON n_regionkey = r_regionkey),
    n AS (SELECT id, who, whom, day, {E_SQL.format('who')} AS a, {E_SQL.format('whom')} AS b, 'time:' || substr(sha256(day), 1, 16) AS t FROM t),
    x AS (SELECT *, 'event:' || substr(sha256(lower(who || ':called:' || whom || ':' || t)), 1, 16) AS e, 'value:' || substr(sha256(lower('phone:' || day || ':' || b)), 1, 16) AS v FROM n),
    l AS (SELECT id, unnest([{{'s': a, 'r': 'observed_in', 'o': 'root', 'w': 0.6}}, {{'s': b, 'r': 'observed_in', 'o': 'root', 'w': 0.6}}, {{'s': e, 'r': 'observed_in', 'o': 'root', 'w': 0.6}}, {{'s': t, 'r': 'observed_in', 'o': 'root', 'w': 0.6}}, {{'s': v, 'r': 'observed_in', 'o': 'root', 'w': 0.6}},
        {{'s': 'root', 'r': 'mentions_entity', 'o': a, 'w': 0.55}}, {{'s': 'root', 'r': 'mentions_entity', 'o': b, 'w': 0.55}}, {{'s': e, 'r': 'actor', 'o': a, 'w': 1.0}}, {{'s': e, 'r': 'acted_on', 'o': b, 'w': 0.9}}, {{'s': e, 'r': 'happened_at', 'o': t, 'w': 0.9}}, {{'s': b, 'r': 'has_value', 'o': v, 'w': 0.9}}]) AS l FROM x)
    SELECT id, l.s AS source, l.r AS relation, l.o AS target, CAST(l.w AS DOUBLE) AS weight FROM l"""


@query("extraction_graph", GRAPH_SQL)
def extraction_graph(spark, sf_dir):
    """The graph of a text: who called whom and when.  A date has digits enough for a phone number, as upstream has it, and goes to the name before it."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    word = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    text = F.concat(word("n_name"), F.lit(" called "), word("r_name"), F.lit(" on 2026-"), F.lpad((1 + F.col("n_nationkey") % 12).cast("string"), 2, "0"), F.lit("-10"))
    rows = X.extracted(n.select(F.col("n_nationkey").cast("long").alias("id"), text.alias("text")))
    return rows.select("id", F.inline(X.graph_edges(F.col("nodes"), F.col("links"))))


WORDS_SQL = r"(SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_''-]+')) AS n FROM documents)"
CHUNK_SQL = f"(SELECT doc_id, CAST(i // 140 + 1 AS BIGINT) AS i, CAST((n + 139) // 140 AS BIGINT) AS last FROM (SELECT doc_id, n, unnest(range(0, n, 140)) AS i FROM {WORDS_SQL}))"


@query("intake_links", f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS d, i, last FROM {CHUNK_SQL})
    SELECT d AS source_id, 'contains_chunk' AS relation, d || '/chunk/' || i AS target_id FROM c UNION ALL SELECT d, 'has_summary', d || '/summary/' || i FROM c
    UNION ALL SELECT d || '/chunk/' || i, 'has_summary', d || '/summary/' || i FROM c UNION ALL SELECT d || '/summary/' || i, 'summarizes', d || '/chunk/' || i FROM c
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'has_summary', doc_id || '/summary/root' FROM documents WHERE trim(text, ' ') <> ''""")
def intake_links(spark, sf_dir):
    """Links between documents, their chunks and the summaries of both."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = I.links(I.packets(docs, extract=False), ("contains_chunk", "has_summary", "summarizes"))
    return rows.select("source_id", "relation", "target_id")


@query("chunk_sequence", f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS d, i FROM {CHUNK_SQL} WHERE i > 1)
    SELECT d || '/chunk/' || (i - 1) AS source_id, 'next_chunk' AS relation, d || '/chunk/' || i AS target_id FROM c UNION ALL SELECT d || '/chunk/' || i, 'previous_chunk', d || '/chunk/' || (i - 1) FROM c""")
def chunk_sequence(spark, sf_dir):
    """Next and previous chunks; a packet's chunks lie in one row, so that no window is needed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return I.links(I.packets(docs, extract=False), ("next_chunk", "previous_chunk")).select("source_id", "relation", "target_id")


@query("turn_projection", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS turns FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id")
def turn_projection(spark, sf_dir):
    return I.turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("recent_context", f"""WITH b AS (SELECT id, seq, list({{'seq': seq, 'id': id}}) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS s, list({{'seq': seq, 'id': id}}) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS t FROM {TURNS_SQL})
    SELECT id, array_to_string(list_transform(list_reverse_sort(list_distinct(list_concat(coalesce(s, []), coalesce(t, []))))[1:12], lambda x: x.id), ' ') AS recent FROM b""")
def recent_context(spark, sf_dir):
    """The twelve newest earlier memories of the same stream or task."""
    return I.recent_context(memories(spark, sf_dir)).select("id", F.array_join("recent", " ").alias("recent"))


@query("consolidation_outputs", f"WITH m AS {TURNS_SQL} SELECT 'knowledge' AS family, 'know_' || {TEXT_HASH.format('id')} AS id, id AS source_id FROM m UNION ALL SELECT 'summaries', id, id FROM m WHERE kind = 'memory_summary' UNION ALL SELECT 'categories', id, id FROM m WHERE kind = 'memory_category'")
def consolidation_outputs(spark, sf_dir):
    """What each memory comes to."""
    return C.outputs(memories(spark, sf_dir)).select("family", "id", "source_id")


@query("consolidation_job", f"SELECT count(*) AS knowledge, count(*) FILTER (kind = 'memory_summary') AS summaries, count(*) FILTER (kind = 'memory_category') AS categories, CAST(0 AS BIGINT) AS embeddings, count(*) AS moments, CAST(3 AS BIGINT) AS associations, CAST(2 AS BIGINT) AS windows FROM {TURNS_SQL}")
def consolidation_job(spark, sf_dir):
    m = memories(spark, sf_dir)
    return C.job(C.outputs(m), m.count(), 3, 2)


@query("consolidation_windows", f"""WITH m AS {TURNS_SQL}, c AS (SELECT substr(id, 1, strpos(id, '-') - 1) AS component, * FROM m)
    SELECT component, count(*) AS size, count(*) - 1 AS edges, CASE WHEN count(DISTINCT stream) > 1 THEN 'mixed' ELSE min(stream) END AS stream, array_to_string(list_sort(list(DISTINCT task_id)), ' ') AS task_ids, min(seq) AS oldest, max(seq) AS newest, 'window_' || row_number() OVER (ORDER BY max(seq) DESC) AS window_id FROM c GROUP BY component""")
def consolidation_windows(spark, sf_dir):
    """A window for each conversation, its turns tied one to the next."""
    m = memories(spark, sf_dir).withColumn("component", F.concat(F.lit("m"), F.col("conv_id").cast("string"))).withColumn("node", F.col("id"))
    w = Window.partitionBy("conv_id").orderBy("seq")
    ties = m.select(F.col("id").alias("target_id"), F.lag("id").over(w).alias("source_id")).filter("source_id IS NOT NULL").withColumn("id", F.concat_ws(">", "source_id", "target_id"))
    out = C.windows(m, ties)
    return out.select("component", "size", "edges", "stream", F.array_join("task_ids", " ").alias("task_ids"), "oldest", "newest", F.col("window").alias("window_id"))


@query("status_latest", f"SELECT 'stream' AS by, stream AS name, max_by(id, seq) AS id, max(seq) AS seq FROM {TURNS_SQL} GROUP BY stream UNION ALL SELECT 'task', task_id, max_by(id, seq), max(seq) FROM {TURNS_SQL} GROUP BY task_id")
def status_latest(spark, sf_dir):
    """The latest memory of every stream and of every task."""
    m = memories(spark, sf_dir)
    return A.statuses(m.withColumn("kind", F.col("id"))).select("by", "name", F.col("kind").alias("id"), "seq")


FLOW_SQL = "(SELECT count(*) AS n, count(*) FILTER (n_regionkey = 0) AS gone FROM nation)"


@query("memory_flow", f"SELECT role, n FROM (SELECT unnest([{{'role': 'root', 'n': n - gone}}, {{'role': 'chunk', 'n': n}}, {{'role': 'summary', 'n': 2 * n}}, {{'role': 'category', 'n': 2 * n}}, {{'role': 'extracted_fact', 'n': 5 * n}}, {{'role': 'promoted', 'n': 11 * n - gone}}, {{'role': 'knowledge', 'n': 11 * n - gone}}]) AS r FROM {FLOW_SQL}), LATERAL (SELECT r.role AS role, r.n AS n)")
def memory_flow(spark, sf_dir):
    """A memory over texts of nations: taken in, some forgotten, consolidated, compacted, and opened again."""
    path = f"{checkpoint_folder(spark)}/memory-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    word = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    text = F.concat(word("n_name"), F.lit(" called "), word("r_name"), F.lit(" on 2026-"), F.lpad((1 + F.col("n_nationkey") % 12).cast("string"), 2, "0"), F.lit("-10"))
    docs = n.select(F.concat(F.col("n_regionkey").cast("string"), F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), text.alias("text"))
    m = Memory(spark, path, "main")
    m.remember(docs)
    m.forget((F.col("role") == "root") & F.startswith("id", F.lit("0n")))
    m.consolidate()
    m.log.compact()
    m = Memory(spark, path, "main")
    rows = m.moments()
    roles = rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    promoted = rows.filter("state = 'promoted'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("promoted").alias("role"), "n")
    known = m.records("knowledge", "source_id string").agg(F.count(F.lit(1)).alias("n")).select(F.lit("knowledge").alias("role"), "n")
    return roles.unionByName(promoted).unionByName(known)


@query("latest_ingestions", f"SELECT id, row_number() OVER (ORDER BY seq DESC, id) AS rank FROM {EVENTS_SQL} WHERE type NOT IN ('summary', 'compaction_marker') QUALIFY rank <= 20")
def latest_ingestions(spark, sf_dir):
    return Q.top(events(spark, sf_dir).filter(~F.col("type").isin("summary", "compaction_marker")), 20, F.desc("seq"), F.col("id")).select("id", "rank")


@query("strongest_summaries", f"SELECT id, row_number() OVER (ORDER BY attention DESC, seq) AS rank FROM {EVENTS_SQL} WHERE type = 'summary' QUALIFY rank <= 5")
def strongest_summaries(spark, sf_dir):
    return Q.top(events(spark, sf_dir).filter("type = 'summary'"), 5, F.desc("attention"), F.col("seq")).select("id", "rank")


@query("knowledge_compaction", f"""WITH m AS (SELECT *, 1.0 + seq % 5 AS attention FROM {TURNS_SQL}), e AS (SELECT * FROM {EVENTS_SQL}),
    f AS (SELECT summary FROM e WHERE type = 'summary' ORDER BY seq LIMIT 1), g AS (SELECT coalesce((SELECT summary FROM f), (SELECT string_agg(left(text, 500), ' | ' ORDER BY attention DESC, seq) FROM (SELECT * FROM m ORDER BY attention DESC, seq LIMIT 5))) AS summary),
    p AS (SELECT 0 AS part, 1 AS r, 'summary' AS type, CAST(NULL AS VARCHAR) AS name, summary, summary AS text FROM g
    UNION ALL SELECT 1, row_number() OVER (ORDER BY attention DESC, seq), 'fact', NULL, NULL, left(text, 500) FROM (SELECT * FROM m WHERE kind = 'memory_summary' ORDER BY attention DESC, seq LIMIT 5)
    UNION ALL SELECT 2, row_number() OVER (ORDER BY seq DESC, id), 'latest_ingestion', NULL, NULL, left(text, 500) FROM (SELECT * FROM m WHERE kind = 'text' ORDER BY seq DESC, id LIMIT 20)
    UNION ALL SELECT 3, seq, type, name, summary, text FROM e WHERE type IN ('skill', 'procedure', 'fact'))
    SELECT type, name, summary, text FROM p QUALIFY row_number() OVER (PARTITION BY type, coalesce(name, summary, text) ORDER BY part DESC, r DESC) = 1""")
def knowledge_compaction(spark, sf_dir):
    """The default compaction: a summary that there was, strongest summaries, latest ingestions, and what is kept."""
    m = memories(spark, sf_dir).withColumn("attention", 1.0 + F.col("seq") % 5)
    e = events(spark, sf_dir).withColumn("source_id", F.lit(None).cast("string"))
    return C.compacted_knowledge(m, e).select("type", "name", "summary", "text")


@query("usage_totals", f"SELECT type, count(*) AS events, count(*) FILTER (usage > 0) AS used, CAST(sum(greatest(1, CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 4 / 3) AS BIGINT))) AS BIGINT) AS tokens FROM {EVENTS_SQL} GROUP BY type")
def usage_totals(spark, sf_dir):
    return A.usage(events(spark, sf_dir))


@query("packet_order", f"SELECT id, row_number() OVER (ORDER BY {RANK_SQL} DESC, seq DESC, id) AS place FROM {EVENTS_SQL} QUALIFY place <= 30")
def packet_order(spark, sf_dir):
    ranked = Q.top(events(spark, sf_dir).withColumn("p", K.priority(F.col("type"))), 30, F.desc("p"), F.desc("seq"), F.col("id"))
    return ranked.select("id", F.col("rank").alias("place"))


@query("semantic_summary", f"SELECT family, count(*) AS count, array_to_string(list_sort(list('e' || seq)), ' ') AS source_ids FROM (SELECT * FROM {LOG_SQL} WHERE family IN ('click', 'view', 'purchase') ORDER BY coalesce(value, 0) DESC, seq LIMIT 1000) GROUP BY family")
def semantic_summary(spark, sf_dir):
    """The strongest records of some families, and what a semantic compaction says of them."""
    rows = log(spark, sf_dir).select("family", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("id"), "seq", F.to_json(F.struct(F.col("value").alias("attention"))).alias("payload"))
    return C.semantic(rows, ["click", "view", "purchase"], 1000).select("family", "count", F.array_join("source_ids", " ").alias("source_ids"))


@query("temporal_rollup", "SELECT o_custkey AS customer, min(o_orderdate) AS occurred_at, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END), TIMESTAMP '2030-01-01') AS observed_at, max(o_orderdate) AS last_verified_at FROM orders GROUP BY o_custkey")
def temporal_rollup(spark, sf_dir):
    """Earliest and latest times of what supports a statement, with a default."""
    o, none = table(spark, sf_dir, "orders"), F.lit(None).cast("timestamp_ntz")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    rows = o.select(F.col("o_custkey").alias("customer"), day.alias("occurred_at"), F.when(F.col("o_orderstatus") == "F", day).alias("observed_at"), day.alias("last_verified_at"), none.alias("valid_from"), none.alias("valid_until"))
    return W.rolled_up(rows, ["customer"], F.lit("2030-01-01").cast("timestamp_ntz")).select("customer", "occurred_at", "observed_at", "last_verified_at")


@query("temporal_normalise", "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 4 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(o_orderdate) - 7200000000 END AS micros FROM orders")
def temporal_normalise(spark, sf_dir):
    """Texts as times: an offset is needed, else they are none."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    m = F.col("o_orderkey") % 4
    text = F.when(m == 0, F.concat(day, F.lit("Z"))).when(m == 1, F.concat(day, F.lit("+02:00"))).when(m == 2, day).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), W.order_key(W.normal(text)).alias("micros"))


@query("action_recipes", f"SELECT 'act_' || {TEXT_HASH.format('p_partkey || chr(31) || ' + chr(39) + 'ship ' + chr(39) + ' || p_name')} AS target_id, CAST(p_partkey AS VARCHAR) AS source_id, 'attached_action' AS relation FROM part")
def action_recipes(spark, sf_dir):
    """Recipes are data: they are attached, never run."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("memory_id"), F.concat(F.lit("ship "), "p_name").alias("text"))
    return K.recipes(p)[1].select("target_id", "source_id", "relation")


@query("forget_by_task", f"SELECT id FROM {TURNS_SQL} WHERE task_id = 'task-3' UNION SELECT id FROM {TURNS_SQL} WHERE stream = 'assistant' UNION SELECT 'm' || conv_id || '-' || turn FROM conversations WHERE conv_id = 5")
def forget_by_task(spark, sf_dir):
    """What selectors name: a task, a stream, a signal."""
    m = memories(spark, sf_dir)
    return D.selected(m, ("task", "task-3")).unionByName(D.selected(m, ("stream", "assistant"))).unionByName(D.selected(m, "s5")).select("id").distinct()


@query("cascade_forget", f"""WITH c AS (SELECT 'c' || c_custkey AS id, 's' || c_custkey AS signal_id, c_custkey FROM customer WHERE c_acctbal < -900), e AS {EDGES_SQL}
    SELECT 'moments' AS family, id FROM c UNION SELECT 'signals', signal_id FROM c UNION SELECT 'associations', e.id FROM e JOIN c ON e.source_id = c.id OR e.target_id = c.id
    UNION SELECT 'action_recipes', 'r' || c_custkey FROM c UNION SELECT 'associations', 'a' || c_custkey FROM c
    UNION SELECT 'knowledge', 'o' || o_orderkey FROM orders JOIN c ON o_custkey = c_custkey UNION SELECT 'observations', 'q' || o_orderkey FROM orders JOIN c ON o_custkey = c_custkey""")
def cascade_forget(spark, sf_dir):
    """Tombstones for what is forgotten and for all that refers to it, by a field or in a list of sources."""
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customers = table(spark, sf_dir, "customer")
    hit = customers.filter("c_acctbal < -900").select(k("c", "c_custkey").alias("id"), k("s", "c_custkey").alias("signal_id"))
    recipes = customers.select(k("a", "c_custkey").alias("id"), k("c", "c_custkey").alias("source_id"), k("r", "c_custkey").alias("target_id"), F.lit("attached_action").alias("relation"))
    ties = edges(spark, sf_dir).withColumn("relation", F.lit("lives_in")).unionByName(recipes)
    o = table(spark, sf_dir, "orders")
    facts = o.select(F.lit("knowledge").alias("family"), k("o", "o_orderkey").alias("id"), F.to_json(F.struct(k("c", "o_custkey").alias("source_id"))).alias("payload"))
    seen = o.select(F.lit("observations").alias("family"), k("q", "o_orderkey").alias("id"), F.to_json(F.struct(F.array(F.lit("x"), k("s", "o_custkey")).alias("source_ids"))).alias("payload"))
    return D.targets(hit, ties, facts.unionByName(seen))


@query("artifacts_2hop", f"WITH e AS {EDGES_SQL}, s AS (SELECT unnest(['c7', 'c9', 'p3']) AS id), n AS (SELECT DISTINCT target_id AS id FROM e JOIN s ON e.source_id = s.id) SELECT 'artifact' AS kind, id FROM n UNION ALL SELECT DISTINCT 'recipe', e.target_id FROM e JOIN n ON e.source_id = n.id WHERE e.target_id LIKE 'g%'")
def artifacts_2hop(spark, sf_dir):
    """The nations of three memories are their artifacts, and the regions attached to these their recipes."""
    e = edges(spark, sf_dir).withColumn("relation", F.when(F.startswith("target_id", F.lit("g")), "attached_action").otherwise("lives_in"))
    ids = seeds(spark, "c7", "c9", "p3")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("g"), F.col("r_regionkey").cast("string")).alias("id"))
    return A.artifacts_for(e, ids, nations).select(F.lit("artifact").alias("kind"), "id").unionByName(A.recipes_for(e, ids, regions).select(F.lit("recipe").alias("kind"), "id"))


MEET = "When did Brand#11 and brand#12 meet part 100, what is the number?"
MEET_KEYS = Q.cue_terms(MEET, 3)


@query("structured_rerank", f"""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_name, lower(p_brand) AS canonical, p_partkey % 4 AS k, 1.0 + p_size % 3 AS attention FROM part)
    SELECT id, CAST(greatest(2.5, CASE WHEN k = 0 AND contains('{MEET.lower()}', canonical) THEN 7 + attention WHEN k = 1 AND list_has_any(list_filter(string_split_regex(lower(p_name), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 3), {MEET_KEYS}) THEN 5 + attention WHEN k = 2 THEN 3 + attention WHEN k = 3 THEN 3 + attention ELSE 0 END) AS DOUBLE) AS score FROM p""")
def structured_rerank(spark, sf_dir):
    """Entities named by the cue, events, times and values that it asks for lift a memory to a floor."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("memory_entity", "memory_event", "memory_time", "memory_value")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), kind.alias("kind"), F.col("p_name").alias("text"), F.lower("p_brand").alias("canonical"), (1.0 + F.col("p_size") % 3).alias("attention"), F.lit(2.5).alias("score"))
    return A.reranked(p, MEET).select("id", F.col("score").cast("double").alias("score"))


@query("merged_search", f"""WITH {bm25_sql('documents')}, act AS (SELECT 'm' || conv_id || '-' || turn AS id, text, 2 * len(list_filter({Q.cue_terms(ASK, 3)}, lambda x: list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), x))) + 3 * len(list_filter({["How", "The", "Heer", "Of"]}, lambda x: list_contains(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), x))) + 3.0 AS score FROM conversations),
    u AS (SELECT 'active' AS source, 'moments' AS family, id, round(CAST(score AS DOUBLE), 6) AS score FROM act UNION ALL SELECT 'durable', 'documents', CAST(doc_id AS VARCHAR), round(bm25, 6) FROM b WHERE bm25 > 0)
    SELECT source, family, id, score FROM u ORDER BY score DESC, id, source, family LIMIT 30""")
def merged_search(spark, sf_dir):
    """Active memories and the durable index in one ranking; a result that both lists repeat counts once."""
    a = Q.active_scores(memories(spark, sf_dir), ASK).select(F.lit("active").alias("source"), F.lit("moments").alias("family"), "id", F.round(F.col("score").cast("double"), 6).alias("score"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = Q.bm25(docs, CUE).filter("bm25 > 0").select(F.lit("durable").alias("source"), F.lit("documents").alias("family"), F.col("doc_id").cast("string").alias("id"), F.round("bm25", 6).alias("score"), "text")
    return A.merged([a, b, a], 30).select("source", "family", "id", "score")


@query("eval_hit_rate", "SELECT CASE WHEN i % 3 = 0 THEN 'fact' ELSE 'research' END AS label, count(*) AS n, CAST(1.0 AS DOUBLE) AS hit_rate FROM range(1, 101) t(i) GROUP BY 1")
def eval_hit_rate(spark, sf_dir):
    """A hundred made-up scenarios, searched for among all of them."""
    i, name = F.col("id"), F.concat(F.lit("EvalSubject"), F.col("id").cast("string"))
    fact = i % 3 == 0
    text = F.when(fact, F.concat(name, F.lit(" email is eval"), i.cast("string"), F.lit("@example.com"))).otherwise(F.concat(F.lit("research "), name, F.lit(" durable hybrid recall checkpoint "), i.cast("string")))
    rows = spark.range(1, 101).select("id", text.alias("text"), F.when(fact, F.concat(name, F.lit(" email"))).otherwise(F.concat(name, F.lit(" hybrid recall"))).alias("cue"), F.when(fact, F.concat(F.lit("eval"), i.cast("string"), F.lit("@example.com"))).otherwise(F.concat(F.lit("checkpoint "), i.cast("string"))).alias("token"), F.when(fact, "fact").otherwise("research").alias("label"))
    return A.hit_rates(A.batch_hits(rows.select("cue", "token", "label"), rows.select("id", "text")))


@query("record_envelopes", "SELECT CAST(c_custkey AS BIGINT) AS id, 'main:' || CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE substr(sha256(c_mktsegment), 1, 16) END || ':moments:put:' || c_custkey AS dedupe_key, md5(c_name) AS digest FROM customer")
def record_envelopes(spark, sf_dir):
    """Envelopes with keys and digests; no scope has a mark of its own."""
    c = table(spark, sf_dir, "customer")
    rows = completed(c.select(F.lit("main").alias("namespace"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("scope"), F.lit("moments").alias("family"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("payload")))
    return rows.select(F.col("id").cast("long").alias("id"), "dedupe_key", "digest")


#: Families of event types, so that events can be records.
KINDS_SQL = "CASE event_type WHEN 'view' THEN 'signals' WHEN 'click' THEN 'moments' WHEN 'signup' THEN 'knowledge' WHEN 'purchase' THEN 'artifacts' ELSE 'observations' END"
REOPEN_SQL = f"""WITH r AS (SELECT event_id, {KINDS_SQL} AS family, CAST(user_id AS VARCHAR) AS id, props AS payload, CASE WHEN event_id % 10 = 0 THEN 'other' ELSE 'main' END AS namespace FROM events),
    k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY namespace, family, id ORDER BY event_id DESC) = 1)
    SELECT namespace, family, id, payload FROM k WHERE namespace = 'other' OR NOT EXISTS (SELECT 1 FROM r g WHERE g.namespace = 'main' AND g.event_id % 97 = 0 AND g.family = k.family AND g.id = k.id)"""


@query("log_reopen", REOPEN_SQL)
def log_reopen(spark, sf_dir):
    """A log written by three sessions, compacted and opened again in between; tombstones of one namespace leave the other alone."""
    path = f"{checkpoint_folder(spark)}/log-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    family = F.col("event_type")
    for kind, name in (("view", "signals"), ("click", "moments"), ("signup", "knowledge"), ("purchase", "artifacts")):
        family = F.when(F.col("event_type") == kind, name).otherwise(family)
    family = F.when(family == "error", "observations").otherwise(family)
    rows = e.select("event_id", F.when(F.col("event_id") % 10 == 0, "other").otherwise("main").alias("namespace"), F.lit(None).cast("string").alias("scope"), family.alias("family"), F.col("user_id").cast("string").alias("id"), F.col("props").alias("payload"))
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0

    def ordered(part):
        return completed(part.repartitionByRange("event_id").sortWithinPartitions("event_id"))

    LogStore(spark, path).append(ordered(rows.filter(F.col("event_id") <= middle)))
    LogStore(spark, path).compact()
    LogStore(spark, path).append(ordered(rows.filter(F.col("event_id") > middle)))
    dead = rows.filter("event_id % 97 = 0 AND namespace = 'main'").select("family", "id").distinct()
    graves = dead.select(F.lit("main").alias("namespace"), F.lit(None).cast("string").alias("scope"), F.lit("tombstones").alias("family"), F.concat_ws("/", "family", "id").alias("id"), F.to_json(F.struct("family", "id")).alias("payload"))
    LogStore(spark, path).append(completed(graves))
    LogStore(spark, path).compact()
    last = LogStore(spark, path)
    return last.replay("main").unionByName(last.replay("other")).select("namespace", "family", "id", "payload")


@query("frame_roundtrip", "SELECT CAST(event_id AS BIGINT) AS seq, event_type AS family, CAST(user_id AS VARCHAR) AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def frame_roundtrip(spark, sf_dir):
    """Events as framed records, written to files and read up to the torn tail that each of them has."""
    path = f"{checkpoint_folder(spark)}/frames-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_type").alias("family"), F.col("user_id").cast("string").alias("id"), F.coalesce("props", F.lit("null")).alias("payload"))
    torn = framed(rows.repartitionByRange("seq")).select(F.hex(F.concat("content", F.lit(b"SQFR torn"))).alias("value"))
    # A line of a text file holds a file of frames as digits here, for Spark writes no raw bytes; without compression the disk would hold each byte twice.
    torn.write.text(path, compression="gzip")
    back = spark.read.text(path).select(F.unhex("value").alias("content"))
    return frames_of(back).select("seq", "family", "id", F.get_json_object("payload", "$.k").cast("long").alias("k"))


@query("fact_governed")
def fact_governed(spark, sf_dir):
    """States that statements lead to when some memories are pinned: a pinned fact holds others back."""
    f = fact_rows(spark, sf_dir)
    told = f.select("fact_key", (F.col("id") * 2).alias("seq"), F.lit("claim").alias("kind"), F.col("id").cast("string").alias("memory_id"), "value", F.lit("short_term").alias("state"))
    pins = f.filter("id % 11 = 0").select("fact_key", (F.col("id") * 2 + 1).alias("seq"), F.lit("state").alias("kind"), F.col("id").cast("string").alias("memory_id"), "value", F.lit("pinned").alias("state"))
    return G.governed_facts(told.unionByName(pins))


@query("secret_roundtrip", "SELECT CAST(c_custkey AS BIGINT) AS id, 'secret: account' AS shown, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'secret: account' END AS revealed, c_custkey % 2 = 1 AS locked FROM customer")
def secret_roundtrip(spark, sf_dir):
    """Seals under a key of its own and reveals to those that a policy allows."""
    key = tokens.token_bytes(32)
    c = table(spark, sf_dir, "customer").select(F.lit("main").alias("namespace"), F.lit(None).cast("string").alias("scope"), F.col("c_custkey").cast("string").alias("id"), F.lit(" account ").alias("label"), F.col("c_name").alias("text"))
    rows = S.sealed(c, key).withColumn("shown", F.col("text"))
    out = S.revealed(rows, key, lambda r: r["id"].cast("long") % 2 == 0)
    return out.select(F.col("id").cast("long").alias("id"), "shown", F.col("text").alias("revealed"), "locked")


MODEL_SQL = "(SELECT CAST(vec_id AS VARCHAR) AS token, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("embed_pool", f"""WITH w AS (SELECT p_partkey AS id, unnest(list_distinct(list_filter(string_split_regex(lower(p_brand || ' ' || p_size || ' ' || p_partkey), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))) AS token FROM part), j AS (SELECT id, v FROM w JOIN {MODEL_SQL} USING (token)),
    m AS (SELECT id, d, avg(x) AS x FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM j) GROUP BY id, d), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM m GROUP BY id)
    SELECT CAST(m.id AS BIGINT) AS id, round(sum(CASE WHEN d = 1 THEN x / n END), 5) AS first, round(sum(x / n * d), 3) AS mix FROM m JOIN n ON m.id = n.id GROUP BY m.id""")
def embed_pool(spark, sf_dir):
    """Texts as the unit mean of the vectors of their words; the embeddings stand for a model whose tokens are numbers."""
    model = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("vector"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("text"))
    rows = E.mean_pooled(p, model, "id")
    mix = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.round(F.get("vector", F.lit(0)), 5).alias("first"), F.round(mix, 3).alias("mix"))


def index(spark, sf_dir):
    """All vectors written, a tenth deleted, and one of seven of these written again."""
    rows = table(spark, sf_dir, "embeddings").select(F.format_string("%06d", "vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "even").alias("scope"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id")
    made = E.VectorIndex.empty(spark).upsert(rows).delete(rows.filter("vec_id % 10 = 3"))
    return made.upsert(rows.filter("vec_id % 70 = 3"))


@query("vector_index", f"SELECT printf('%06d', vec_id) AS id, score, distance AS hamming FROM (SELECT vec_id, round(4 * greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({VEC0} AS DOUBLE[]))) + 4 * (1 - {HAMMING_SQL} / 64.0), 5) AS score, {HAMMING_SQL} AS distance FROM embeddings WHERE (vec_id % 10 <> 3 OR vec_id % 70 = 3) AND label % 2 = 0) ORDER BY score DESC, distance, id LIMIT 40")
def vector_index(spark, sf_dir):
    """The exact search of an index after writes and deletions."""
    cue = list(table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"])
    out = index(spark, sf_dir).exact(cue, 40, "even")
    return out.select("id", F.round("score", 5).alias("score"), F.col("hamming").cast("long").alias("hamming"))


@query("vector_near")
def vector_near(spark, sf_dir):
    """The search by sign bits, twice as wide until enough are in scope; tests hold its recall against the exact one."""
    cue = list(table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"])
    return index(spark, sf_dir).near(cue, 40, "even")


@query("namespace_bound", f"SELECT family, seq FROM (SELECT family, seq FROM {LOG_SQL} QUALIFY row_number() OVER (PARTITION BY family ORDER BY seq DESC) <= 1000) QUALIFY row_number() OVER (ORDER BY seq DESC) <= 3000")
def namespace_bound(spark, sf_dir):
    """The newest rows of each partition, then of the whole namespace."""
    return L.newest(log(spark, sf_dir), ["family"], 1000).orderBy(F.desc("seq")).limit(3000).select("family", "seq")


@query("turn_gaps", "SELECT conv_id, turn, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations QUALIFY gap IS NOT NULL")
def turn_gaps(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - F.lag("turn").over(w)).alias("gap")).filter("gap IS NOT NULL")
