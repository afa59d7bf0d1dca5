"""Retrieval, log, governance and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import predicates as P
from strataq.functions import text as T
from strataq.functions import vectors as V
from strataq.operators import governance as G
from strataq.operators import graph as R
from strataq.operators import log as L
from strataq.operators import retrieval as Q
from strataq.plans.registry import query, table
from strataq.plans.text_queries import FACT_SQL, FINGER_SQL, facts, fingerprints

CUE = "the of and reand ingly"
TERMS = Q.cue_terms(CUE)
TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
STATE_SQL = "CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'promoted' WHEN quality = 0 THEN 'stale' END"
#: Documents with lifecycle states, one row a document.
DOCS_SQL = f"(SELECT d.doc_id, d.text, l.state FROM documents d LEFT JOIN (SELECT doc_id, max({STATE_SQL}) AS state FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"


def stated(spark, sf_dir):
    state = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "promoted").when(F.col("quality") == 0, "stale")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(state).alias("state"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")


def bm25_sql(docs: str) -> str:
    return f"""
    t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2) AS terms FROM {docs}),
    f AS (SELECT doc_id, len(terms) AS n, unnest({TERMS_SQL}) AS term, terms FROM t),
    c AS (SELECT doc_id, n, term, len(list_filter(terms, lambda x: x = term)) AS tf FROM f),
    s AS (SELECT count(*) AS docs, greatest(1.0, avg(len(terms))) AS avg_len FROM t),
    d AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM c GROUP BY term),
    b AS (SELECT c.doc_id, sum(CASE WHEN tf > 0 THEN ln(1.0 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * n / avg_len)) ELSE 0 END) AS bm25, count(*) FILTER (tf > 0) AS exact
          FROM c JOIN d USING (term) CROSS JOIN s GROUP BY c.doc_id)"""


@query("bm25_search", f"WITH {bm25_sql('documents')} SELECT doc_id, round(bm25, 6) AS score, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM b WHERE bm25 > 0 QUALIFY rank <= 10")
def bm25_search(spark, sf_dir):
    rows = Q.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), CUE).filter("bm25 > 0").select("doc_id", F.round("bm25", 6).alias("score"))
    return Q.top(rows, 10, F.desc("score"), F.col("doc_id"))


HYBRID_SQL = f"""WITH v AS (SELECT * FROM {DOCS_SQL} WHERE state IS DISTINCT FROM 'contradicted' AND state IS DISTINCT FROM 'forgotten'), {bm25_sql('v')},
    h AS (SELECT doc_id, state, round(bm25 + CASE WHEN contains(lower(text), '{CUE}') THEN 4.0 ELSE 0 END + 1.5 * exact + CASE state WHEN 'pinned' THEN 5.0 WHEN 'promoted' THEN 2.0 WHEN 'short_term' THEN 0.5 WHEN 'stale' THEN -2.0 ELSE 0 END, 6) AS score FROM v JOIN b USING (doc_id))"""


@query("durable_hybrid", f"{HYBRID_SQL} SELECT doc_id, state, score, row_number() OVER (ORDER BY score DESC, doc_id DESC) AS rank FROM h WHERE score > 0 QUALIFY rank <= 10")
def durable_hybrid(spark, sf_dir):
    rows = Q.hybrid(stated(spark, sf_dir), CUE).select("doc_id", "state", F.round("score", 6).alias("score"))
    return Q.top(rows, 10, F.desc("score"), F.desc("doc_id"))


@query("lifecycle_boost", f"SELECT doc_id, CASE state WHEN 'promoted' THEN 2.0 WHEN 'stale' THEN -2.0 ELSE 0.0 END::DOUBLE AS boost FROM {DOCS_SQL}")
def lifecycle_boost(spark, sf_dir):
    return stated(spark, sf_dir).select("doc_id", P.boost(F.col("state")).alias("boost"))


@query("phrase_exact", f"SELECT doc_id, CASE WHEN contains(lower(text), 'of the') THEN 4.0 ELSE 0.0 END::DOUBLE AS phrase, CAST(len(list_filter({TERMS_SQL}, lambda x: list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), x))) AS BIGINT) AS exact FROM documents")
def phrase_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    exact = F.size(F.array_intersect(T.keywords(F.col("text"), 2), F.array(*[F.lit(t) for t in TERMS])))
    return d.select("doc_id", F.when(F.contains(F.lower("text"), F.lit("of the")), 4.0).otherwise(0.0).alias("phrase"), exact.cast("long").alias("exact"))


@query("visible_filter", f"SELECT doc_id, state FROM {DOCS_SQL} WHERE coalesce(state, '') NOT IN ('contradicted', 'forgotten')")
def visible_filter(spark, sf_dir):
    return stated(spark, sf_dir).filter(P.visible(F.col("state"))).select("doc_id", "state")


@query("consolidatable", f"SELECT doc_id, state FROM {DOCS_SQL} WHERE state IS NULL OR state IN ('candidate', 'short_term', 'stale')")
def consolidatable(spark, sf_dir):
    return stated(spark, sf_dir).filter(P.consolidatable(F.col("state"))).select("doc_id", "state")


VEC0 = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def cue_vector(spark, sf_dir):
    """The vector with the least id, as one row."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("cue"))


@query("cosine_topk", f"SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({VEC0} AS DOUBLE[])), 6) AS score FROM embeddings) QUALIFY rank <= 40")
def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").join(F.broadcast(cue_vector(spark, sf_dir)))  # one row
    return Q.top(rows.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("cue")), 6).alias("score")), 40, F.desc("score"), F.col("vec_id"))


BITS_SQL = "array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')"


@query("quantize", f"SELECT vec_id, {BITS_SQL} AS bits FROM embeddings")
def quantize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.sign_bits(F.col("embedding"), 64).alias("bits"))


HAMMING_SQL = f"CAST(list_sum(list_transform(list_zip(embedding, {VEC0}), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS BIGINT)"


@query("hamming_topk", f"SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT vec_id, {HAMMING_SQL} AS distance FROM embeddings) QUALIFY rank <= 40")
def hamming_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").join(F.broadcast(cue_vector(spark, sf_dir)))  # one row
    d = F.bit_count(V.signature(F.col("embedding")).bitwiseXOR(V.signature(F.col("cue")))).cast("long")
    return Q.top(rows.select("vec_id", d.alias("distance")), 40, F.col("distance"), F.col("vec_id"))


@query("vector_hybrid", f"SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, CAST(label AS BIGINT) AS label, round(4 * greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({VEC0} AS DOUBLE[]))) + 4 * (1 - {HAMMING_SQL} / 64.0), 5) AS score FROM embeddings WHERE label = 3) QUALIFY rank <= 40")
def vector_hybrid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter("label = 3").join(F.broadcast(cue_vector(spark, sf_dir)))  # one row
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.round(V.vector_score(F.col("embedding"), F.col("cue")), 5).alias("score"))
    return Q.top(rows, 40, F.desc("score"), F.col("vec_id"))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def vector_norms(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(e), 5).alias("norm"), F.round(V.norm(V.normalise(e)), 5).alias("unit"))


@query("fingerprint_match", f"WITH f AS {FINGER_SQL}, q AS (SELECT fingerprint AS g FROM f ORDER BY doc_id LIMIT 1) SELECT doc_id, round(4 * (1 - bit_count(xor(fingerprint, g)) / 32.0), 6) AS score FROM f, q WHERE 1 - bit_count(xor(fingerprint, g)) / 32.0 >= 0.62")
def fingerprint_match(spark, sf_dir):
    # inline() keeps the filter from computing every fingerprint a second time.
    f = fingerprints(spark, sf_dir).select("doc_id", F.inline(F.array(F.struct("fingerprint"))))
    first = table(spark, sf_dir, "documents").orderBy("doc_id").limit(1)  # its fingerprint alone, not all of them to sort
    cue = first.select(T.simhash(F.col("text")).alias("fingerprint")).first()
    like = 1 - T.hamming(F.col("fingerprint"), F.lit(cue["fingerprint"]).cast("long")) / 32
    return f.filter(like >= 0.62).select("doc_id", F.round(4 * like, 6).alias("score"))


@query("rrf_fusion", f"WITH {bm25_sql('documents')}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM b WHERE bm25 > 0 QUALIFY rank <= 50 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY exact DESC, doc_id) AS rank FROM b QUALIFY rank <= 50 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50) SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM r GROUP BY doc_id")
def rrf_fusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = Q.bm25(docs, CUE)
    lists = [
        Q.top(b.filter("bm25 > 0").select("doc_id", F.round("bm25", 6).alias("s")), 50, F.desc("s"), F.col("doc_id")),
        Q.top(b.select("doc_id", "exact"), 50, F.desc("exact"), F.col("doc_id")),
        Q.top(docs.select("doc_id", F.length("text").alias("s")), 50, F.desc("s"), F.col("doc_id")),
    ]
    return Q.fuse(lists, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


def moments(spark, sf_dir):
    """Conversation turns as memories: stream by role, task by conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("id"), "conv_id", "turn", F.col("role").alias("stream"), F.concat(F.lit("task-"), F.col("conv_id").cast("string")).alias("task_id"), "text", F.lit(1.0).alias("attention"))


MOMENTS_SQL = "(SELECT CAST(conv_id * 100 + turn AS BIGINT) AS id, conv_id, turn, role AS stream, 'task-' || conv_id AS task_id, text, 1.0 AS attention FROM conversations)"
ASK = "How is The Heer going with Of and the reand"
ASK_KEYS, ASK_NAMES = Q.cue_terms(ASK, 3), ["How", "The", "Heer", "Of"]


@query("active_score", f"""WITH s AS (SELECT id, 2 * len(list_filter({ASK_KEYS}, lambda x: list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), x))) + 3 * len(list_filter({ASK_NAMES}, lambda x: list_contains(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), x))) + 2 AS m FROM {MOMENTS_SQL})
    SELECT id, (m + 1.0)::DOUBLE AS score, row_number() OVER (ORDER BY m + 1.0 DESC, id) AS rank FROM s WHERE m > 0 QUALIFY rank <= 20""")
def active_score(spark, sf_dir):
    rows = Q.active_scores(moments(spark, sf_dir), ASK).select("id", F.col("score").cast("double").alias("score"))
    return Q.top(rows, 20, F.desc("score"), F.col("id"))


@query("recall_rerank", f"""WITH s AS (SELECT id, conv_id, 2 * len(list_filter({ASK_KEYS}, lambda x: list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), x))) + 3 * len(list_filter({ASK_NAMES}, lambda x: list_contains(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), x))) + 3.0 AS score FROM {MOMENTS_SQL}),
    base AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10),
    near AS (SELECT DISTINCT s.id, s.score FROM s JOIN base USING (conv_id)),
    u AS (SELECT id, score FROM near UNION SELECT id, score FROM base)
    SELECT id, score::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM u QUALIFY rank <= 15""")
def recall_rerank(spark, sf_dir):
    """Base candidates, their graph neighbours (turns of one conversation), then one ranking of the union."""
    scored = Q.active_scores(moments(spark, sf_dir), ASK).select("id", "conv_id", F.col("score").cast("double").alias("score"))
    base = Q.top(scored, 10, F.desc("score"), F.col("id")).drop("rank")
    near = scored.join(F.broadcast(base.select("conv_id").distinct()), "conv_id", "left_semi")  # ten rows at most
    return Q.top(near.unionByName(base).dropDuplicates(["id"]).select("id", "score"), 15, F.desc("score"), F.col("id"))


LOG_SQL = "(SELECT event_id AS seq, event_type AS family, CAST(user_id AS BIGINT) AS id, event_type || ':' || user_id AS dedupe_key, props AS payload, md5(props) AS digest, value FROM events)"
GRAVES_SQL = "(SELECT DISTINCT event_type AS family, CAST(user_id AS BIGINT) AS id FROM events WHERE event_id % 97 = 0)"


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("family"), F.col("user_id").cast("long").alias("id"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("dedupe_key"), F.col("props").alias("payload"), F.md5("props").alias("digest"), "value")


def graves(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_id % 97 = 0").select(F.col("event_type").alias("family"), F.col("user_id").cast("long").alias("id")).distinct()


@query("replay_latest", f"SELECT dedupe_key, seq, payload FROM {LOG_SQL} QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY seq DESC) = 1")
def replay_latest(spark, sf_dir):
    return L.latest(log(spark, sf_dir)).select("dedupe_key", "seq", "payload")


@query("idempotent_append", f"SELECT dedupe_key, seq, digest FROM {LOG_SQL} QUALIFY lag(digest) OVER (PARTITION BY dedupe_key ORDER BY seq) IS DISTINCT FROM digest")
def idempotent_append(spark, sf_dir):
    return L.changed(log(spark, sf_dir)).select("dedupe_key", "seq", "digest")


@query("tombstone_antijoin", f"SELECT l.seq, l.family, l.id FROM {LOG_SQL} l WHERE NOT EXISTS (SELECT 1 FROM {GRAVES_SQL} g WHERE g.family = l.family AND g.id = l.id)")
def tombstone_antijoin(spark, sf_dir):
    return L.without_tombstones(log(spark, sf_dir), graves(spark, sf_dir)).select("seq", "family", "id")


@query("physical_compact", f"SELECT * FROM (SELECT seq, dedupe_key, family, id FROM {LOG_SQL} QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY seq DESC) = 1) l WHERE NOT EXISTS (SELECT 1 FROM {GRAVES_SQL} g WHERE g.family = l.family AND g.id = l.id)")
def physical_compact(spark, sf_dir):
    return L.compacted(log(spark, sf_dir), graves(spark, sf_dir)).select("seq", "dedupe_key", "family", "id")


@query("semantic_select", f"SELECT seq, round(value, 6) AS priority FROM {LOG_SQL} ORDER BY coalesce(value, 0) DESC, seq LIMIT 1000")
def semantic_select(spark, sf_dir):
    return L.strongest(log(spark, sf_dir), F.col("value")).select("seq", F.round("priority", 6).alias("priority"))


@query("hot_eviction", f"SELECT family, seq FROM {LOG_SQL} QUALIFY row_number() OVER (PARTITION BY family ORDER BY seq DESC) <= 1000")
def hot_eviction(spark, sf_dir):
    return L.newest(log(spark, sf_dir), ["family"], 1000).select("family", "seq")


MOVE_SQL = "(SELECT CAST(user_id * 10 + event_id % 10 AS BIGINT) AS memory_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'short_term' WHEN 'click' THEN 'promoted' WHEN 'signup' THEN 'candidate' WHEN 'purchase' THEN 'stale' ELSE CASE WHEN event_id % 3 = 0 THEN 'contradicted' ELSE 'pinned' END END AS state FROM events)"


def moves(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "view", "short_term").when(kind == "click", "promoted").when(kind == "signup", "candidate").when(kind == "purchase", "stale").otherwise(F.when(F.col("event_id") % 3 == 0, "contradicted").otherwise("pinned"))
    return table(spark, sf_dir, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).cast("long").alias("memory_id"), F.col("event_id").alias("seq"), state.alias("state"))


@query("latest_state", f"SELECT memory_id, max_by(state, seq) AS state FROM {MOVE_SQL} GROUP BY memory_id")
def latest_state(spark, sf_dir):
    return G.latest_state(moves(spark, sf_dir))


GOES_SQL = "a = 'none' OR a = s OR " + " OR ".join(f"(a = '{k}' AND s IN ({', '.join(repr(x) for x in v)}))" for k, v in P.TRANSITIONS.items() if v)


@query("lifecycle_fold", f"SELECT memory_id, list_reduce(['none'] || list(state ORDER BY seq), lambda a, s: CASE WHEN {GOES_SQL} THEN s ELSE a END) AS state FROM {MOVE_SQL} GROUP BY memory_id")
def lifecycle_fold(spark, sf_dir):
    return G.folded_state(moves(spark, sf_dir), block=2000)


def fact_rows(spark, sf_dir):
    return facts(spark, sf_dir).select("id", T.fact_claim(F.col("text")).alias("f")).select("id", F.concat_ws(":", "f.subject", "f.attribute").alias("fact_key"), "f.subject", "f.attribute", "f.value")


FACT_ROWS_SQL = f"(SELECT id, subject || ':' || attribute AS fact_key, subject, attribute, value FROM {FACT_SQL})"


@query("fact_current", f"SELECT fact_key, max_by(value, id) AS value, max(id) AS id FROM {FACT_ROWS_SQL} GROUP BY fact_key")
def fact_current(spark, sf_dir):
    return G.current_facts(fact_rows(spark, sf_dir))


@query("fact_upsert", f"SELECT id, fact_key, CASE WHEN b IS NULL THEN 'fact_observed' WHEN b = value THEN 'fact_verified' ELSE 'fact_replaced_previous' END AS reason, CASE WHEN b <> value THEN bi END AS contradicts FROM (SELECT *, lag(value) OVER w AS b, lag(id) OVER w AS bi FROM {FACT_ROWS_SQL} WINDOW w AS (PARTITION BY fact_key ORDER BY id))")
def fact_upsert(spark, sf_dir):
    return G.fact_events(fact_rows(spark, sf_dir)).select("id", "fact_key", "reason", "contradicts")


@query("stale_decay", f"SELECT id, fact_key FROM {FACT_ROWS_SQL} WHERE id % 7 <> 0 AND id < 500")
def stale_decay(spark, sf_dir):
    states = fact_rows(spark, sf_dir).select("id", "fact_key", F.when(F.col("id") % 7 == 0, "pinned").otherwise("promoted").alias("state"), F.lit(None).cast("long").alias("last_verified"), F.col("id").alias("observed"), F.lit(0).cast("long").alias("inserted"))
    return G.stale(states, 500).select("id", "fact_key")


SCOPED_SQL = "(SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'main' ELSE 'other' END AS namespace, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS scope FROM customer)"


@query("scope_nullsafe", f"SELECT id FROM {SCOPED_SQL} WHERE namespace = 'main' AND scope IS NOT DISTINCT FROM NULL")
def scope_nullsafe(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "main").otherwise("other").alias("namespace"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("scope"))
    return c.filter(P.in_partition("main", None)).select("id")


@query("temporal_range", "SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31'")
def temporal_range(spark, sf_dir):
    import datetime as dt

    day = F.col("o_orderdate").cast("date")
    o = table(spark, sf_dir, "orders")
    return o.filter(P.in_time(day, dt.date(1995, 1, 1), None) & (F.col("o_orderdate") <= F.to_timestamp_ntz(F.lit("1995-12-31")))).select(F.col("o_orderkey").cast("long").alias("id"))


@query("valid_at", "SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE (p_size % 5 = 0 OR p_size <= 25) AND (p_size % 3 = 0 OR p_size + 10 >= 25)")
def valid_at(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    start, end = F.when(F.col("p_size") % 5 != 0, F.col("p_size")), F.when(F.col("p_size") % 3 != 0, F.col("p_size") + 10)
    return p.filter(P.valid_at(start, end, 25)).select(F.col("p_partkey").cast("long").alias("id"))


EDGES_SQL = "(SELECT 'e' || c_custkey AS id, 'c' || c_custkey AS source_id, 'n' || c_nationkey AS target_id FROM customer UNION ALL SELECT 's' || s_suppkey, 'p' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || n_nationkey, 'n' || n_nationkey, 'g' || n_regionkey FROM nation)"


def edges(spark, sf_dir):
    def make(t, prefix, a, pa, b, pb):
        k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        return table(spark, sf_dir, t).select(k(prefix, a).alias("id"), k(pa, a).alias("source_id"), k(pb, b).alias("target_id"))

    return make("customer", "e", "c_custkey", "c", "c_nationkey", "n").unionByName(make("supplier", "s", "s_suppkey", "p", "s_nationkey", "n")).unionByName(make("nation", "r", "n_nationkey", "n", "n_regionkey", "g"))


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node string")


@query("incident_edges", f"SELECT DISTINCT id, source_id, target_id FROM {EDGES_SQL} WHERE source_id IN ('n3', 'c7') OR target_id IN ('n3', 'c7')")
def incident_edges(spark, sf_dir):
    return R.incident(edges(spark, sf_dir), seeds(spark, "n3", "c7")).select("id", "source_id", "target_id")


@query("bfs_2hop", f"WITH e AS (SELECT source_id AS a, target_id AS b FROM {EDGES_SQL} UNION SELECT target_id, source_id FROM {EDGES_SQL}), d1 AS (SELECT DISTINCT b AS node FROM e WHERE a = 'c7'), d2 AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT node FROM d1)) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT 'c7' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) GROUP BY node")
def bfs_2hop(spark, sf_dir):
    return R.reach(edges(spark, sf_dir), seeds(spark, "c7"), 2)


@query("edge_integrity", f"SELECT id FROM {EDGES_SQL} e WHERE substr(source_id, 1, 1) = 'c' AND CAST(substr(source_id, 2) AS BIGINT) % 2 = CAST(substr(target_id, 2) AS BIGINT) % 2")
def edge_integrity(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), (F.col("c_custkey") % 2).cast("string").alias("scope"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), (F.col("n_nationkey") % 2).cast("string").alias("scope"))
    return R.intact(edges(spark, sf_dir), c.unionByName(n)).select("id")


TREE_SQL = "WITH RECURSIVE up(node, pos) AS (SELECT CAST(c_custkey AS BIGINT), CAST(c_custkey AS BIGINT) FROM customer UNION ALL SELECT node, pos // 2 FROM up WHERE pos % 5 <> 0 AND pos > 1), top AS (SELECT node, min(pos) AS component FROM up GROUP BY node)"


def tree(spark, sf_dir):
    """Customers linked to the one of half their key, unless five divides it."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("node"))
    e = c.filter("node % 5 <> 0 AND node > 1").select(F.col("node").alias("id"), F.col("node").alias("source_id"), F.floor(F.col("node") / 2).alias("target_id"))
    return c, e


@query("connected_components", f"{TREE_SQL} SELECT node, component FROM top")
def connected_components(spark, sf_dir):
    return R.components(*tree(spark, sf_dir))


@query("window_summary", f"{TREE_SQL} SELECT component, count(*) AS size, max(node) AS newest, min(node) AS oldest, CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN 'mixed' ELSE min(c_mktsegment) END AS stream, row_number() OVER (ORDER BY max(node) DESC) AS win FROM top JOIN customer ON node = c_custkey GROUP BY component")
def window_summary(spark, sf_dir):
    c, e = tree(spark, sf_dir)
    lanes = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("node"), "c_mktsegment")
    w = R.components(c, e).join(lanes, "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("node").alias("newest"), F.min("node").alias("oldest"), F.min("c_mktsegment").alias("_a"), F.max("c_mktsegment").alias("_b"))
    rows = Q.numbered(w, F.desc("newest"))
    return rows.select("component", "size", "newest", "oldest", F.when(F.col("_a") != F.col("_b"), "mixed").otherwise(F.col("_a")).alias("stream"), F.col("rank").alias("win"))
