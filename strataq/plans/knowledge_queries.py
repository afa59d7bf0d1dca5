"""Observation, knowledge, budget, intake, secret and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import text as T
from strataq.operators import intake as I
from strataq.operators import knowledge as K
from strataq.operators import observations as O
from strataq.operators import retrieval as Q
from strataq.plans.memory_queries import FACT_ROWS_SQL, GOES_SQL, LOG_SQL, MOVE_SQL, fact_rows
from strataq.plans.registry import query, table
from strataq.plans.text_queries import CLAIMS_SQL, PHRASES_SQL, phrases
from strataq.streaming import ingest as S

CONF_SQL = "greatest(0.0, least(0.98, {base} + {p} * 0.12 - {c} * 0.1))"
STATE_SQL = "CASE WHEN {c} > {p} THEN 'contradicted' WHEN {p} >= 2 THEN 'promoted' ELSE 'candidate' END"
TREND_SQL = "CASE WHEN {c} = 0 AND {p} >= 2 THEN 'strengthening' WHEN {c} > 0 THEN 'weakening' ELSE 'stable' END"
FACT_OBS_SQL = f"""(SELECT statement, p AS proof_count, c AS contradiction_count, round({CONF_SQL.format(base=0.75, p='p', c='c')}, 6)::DOUBLE AS confidence, {TREND_SQL.format(p='p', c='c')} AS trend, {STATE_SQL.format(p='p', c='c')} AS state
    FROM (SELECT subject || ' ' || attribute || ' is ' || value AS statement, p, CAST(sum(p) OVER (PARTITION BY fact_key) AS BIGINT) - p AS c FROM (SELECT fact_key, subject, attribute, value, count(*) AS p FROM {FACT_ROWS_SQL} GROUP BY ALL)))"""


def fact_obs(spark, sf_dir):
    return O.fact_observations(fact_rows(spark, sf_dir)).select("statement", "proof_count", "contradiction_count", F.round("confidence", 6).alias("confidence"), "trend", "state")


@query("fact_observations", f"SELECT * FROM {FACT_OBS_SQL}")
def fact_observations(spark, sf_dir):
    return fact_obs(spark, sf_dir)


@query("typed_observations", f"WITH x AS ({CLAIMS_SQL}) SELECT type, statement, count(*) AS proof_count, round(greatest(0.0, least(0.98, max(confidence) + count(*) * 0.12)), 6)::DOUBLE AS confidence, CASE WHEN count(*) >= 2 THEN 'promoted' ELSE 'candidate' END AS state FROM x GROUP BY type, statement")
def typed_observations(spark, sf_dir):
    claims = phrases(spark, sf_dir).select("id", F.inline(T.claims(F.col("text"))))
    return O.typed_observations(claims).select("type", "statement", "proof_count", F.round("confidence", 6).alias("confidence"), "state")


@query("verify_observation", f"""WITH e AS (SELECT CAST(user_id AS BIGINT) AS key, event_id AS seq, CASE event_type WHEN 'click' THEN 'supports' WHEN 'view' THEN 'weakens' WHEN 'error' THEN 'contradicts' ELSE 'neutral' END AS relation FROM events),
    a AS (SELECT key, list(CASE relation WHEN 'supports' THEN 0.08 WHEN 'weakens' THEN -0.08 WHEN 'contradicts' THEN -0.16 ELSE 0.0 END::DOUBLE ORDER BY seq) AS moves, count(*) FILTER (relation = 'supports') + 1 AS p, count(*) FILTER (relation IN ('weakens', 'contradicts')) AS c, max_by(relation, seq) AS last FROM e GROUP BY key)
    SELECT key, p AS proof_count, c AS contradiction_count, round(list_reduce([0.5::DOUBLE] || moves, lambda a, x: greatest(0.0::DOUBLE, least(0.98::DOUBLE, a + x))), 6) AS confidence, CASE last WHEN 'supports' THEN 'strengthening' WHEN 'weakens' THEN 'weakening' WHEN 'contradicts' THEN 'contradicted' ELSE 'stable' END AS trend, {STATE_SQL.format(p='p', c='c')} AS state FROM a""")
def verify_observation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    relation = F.when(F.col("event_type") == "click", "supports").when(F.col("event_type") == "view", "weakens").when(F.col("event_type") == "error", "contradicts").otherwise("neutral")
    checks = e.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").alias("seq"), relation.alias("relation"))
    start = checks.select("key").distinct().withColumns({"proof_count": F.lit(1).cast("long"), "contradiction_count": F.lit(0).cast("long"), "confidence": F.lit(0.5)})
    return O.verified(start, checks).withColumn("confidence", F.round("confidence", 6))


@query("observation_search", f"SELECT statement, round(2 * k + confidence, 6) AS score FROM (SELECT statement, confidence, len(list_filter(['status', 'building', 'customer7'], lambda x: list_contains(string_split_regex(statement, '[^\\p{{L}}\\p{{N}}_]+'), x))) AS k FROM {FACT_OBS_SQL}) WHERE k > 0 ORDER BY score DESC, statement LIMIT 20")
def observation_search(spark, sf_dir):
    shared = F.size(F.array_intersect(T.keywords(F.col("statement"), 2), F.array(F.lit("status"), F.lit("building"), F.lit("customer7"))))
    rows = fact_obs(spark, sf_dir).withColumn("k", shared).filter("k > 0").select("statement", F.round(2 * F.col("k") + F.col("confidence"), 6).alias("score"))
    return Q.top(rows, 20, F.desc("score"), F.col("statement")).drop("rank")


MODELS_SQL = "(SELECT 'mm_' || substr(sha256('main' || chr(31) || '-' || chr(31) || p_brand || chr(31) || p_brand || ' ' || p_type), 1, 24) AS id, p_brand AS title, p_brand || ' ' || p_type AS query, string_agg(p_name, '; ' ORDER BY p_partkey) AS answer FROM part GROUP BY p_brand, p_type)"


def models(spark, sf_dir):
    """What is known of a brand and type."""
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("_p"))
    rows = g.select(F.col("p_brand").alias("title"), F.concat("p_brand", F.lit(" "), "p_type").alias("query"), F.array_join(F.transform("_p", lambda x: x["p_name"]), "; ").alias("answer"))
    return K.mental_models(rows, "main").select("id", "title", "query", "answer")


@query("mental_models", f"SELECT * FROM {MODELS_SQL}")
def mental_models(spark, sf_dir):
    return models(spark, sf_dir)


@query("mental_model_search", f"SELECT id, CAST(len(list_filter(['brand', '11', 'steel'], lambda x: list_contains(string_split_regex(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), x))) AS BIGINT) AS score FROM {MODELS_SQL} WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def mental_model_search(spark, sf_dir):
    shared = F.size(F.array_intersect(T.keywords(F.col("query"), 2), F.array(F.lit("brand"), F.lit("11"), F.lit("steel")))).cast("long")
    rows = models(spark, sf_dir).withColumn("score", shared).filter("score > 0").select("id", "score")
    return Q.top(rows, 20, F.desc("score"), F.col("id")).drop("rank")


@query("reflect_confidence", "SELECT CAST(c_nationkey AS BIGINT) AS cue, CAST(count(*) AS BIGINT) AS memories, round(least(1.0, count(*) / 5.0), 6)::DOUBLE AS packet, round(CASE WHEN count(*) FILTER (c_custkey % 50 = 0) > 0 THEN 0.9 WHEN count(*) FILTER (c_custkey % 11 = 0) > 0 THEN least(0.85, 0.4 + count(*) FILTER (c_custkey % 11 = 0) * 0.1) ELSE least(0.7, 0.25 + count(*) * 0.08) END, 6)::DOUBLE AS reflection FROM customer GROUP BY c_nationkey")
def reflect_confidence(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("cue")).agg(F.count(F.lit(1)).alias("memories"), F.count_if(F.col("c_custkey") % 50 == 0).alias("_m"), F.count_if(F.col("c_custkey") % 11 == 0).alias("_o"))
    return g.select("cue", "memories", F.round(O.packet_confidence(F.col("memories")), 6).alias("packet"), F.round(O.reflection_confidence(F.col("_m"), F.col("_o"), F.col("memories")), 6).alias("reflection"))


KINDS = ["summary", "skill", "procedure", "fact", "latest_ingestion", "compaction_marker"]
EVENTS_SQL = f"(SELECT 'k' || p_partkey AS id, CAST(p_partkey AS BIGINT) AS seq, {KINDS}[p_partkey % 6 + 1] AS type, p_name || ' ' || p_brand AS text, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS summary, CAST(p_size % 8 AS BIGINT) AS usage, p_retailprice / 500 AS attention, CAST(length(p_name) + 40 AS BIGINT) AS bytes FROM part)"
RANK_SQL = "CASE type WHEN 'summary' THEN 100 WHEN 'skill' THEN 90 WHEN 'procedure' THEN 80 WHEN 'fact' THEN 70 WHEN 'latest_ingestion' THEN 60 WHEN 'compaction_marker' THEN 10 ELSE 0 END"


def events(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select(
        F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").cast("long").alias("seq"), kind.alias("type"), F.concat("p_name", F.lit(" "), "p_brand").alias("text"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).alias("summary"), (F.col("p_size") % 8).cast("long").alias("usage"), (F.col("p_retailprice") / 500).alias("attention"), (F.length("p_name") + 40).cast("long").alias("bytes"),
    )


@query("knowledge_rank", f"SELECT id, row_number() OVER (ORDER BY {RANK_SQL} DESC, usage DESC, attention DESC, seq DESC, id) AS rank FROM {EVENTS_SQL} QUALIFY rank <= 50")
def knowledge_rank(spark, sf_dir):
    return Q.top(events(spark, sf_dir), 50, *K.rank_order()).select("id", "rank")


@query("knowledge_search", f"SELECT id, CAST(3 * len(list_filter(['part', 'brand', '100'], lambda x: list_contains(string_split_regex(lower(text), '[^a-z0-9_]+'), x))) + CASE WHEN contains(lower(text), 'part brand 100') THEN 4 ELSE 0 END + {RANK_SQL} // 25 + least(usage, 5) + floor(least(attention, 5)) AS BIGINT) AS score FROM {EVENTS_SQL} WHERE score > 0 ORDER BY score DESC, seq DESC, id LIMIT 25")
def knowledge_search(spark, sf_dir):
    rows = K.searched(events(spark, sf_dir), "part brand 100")
    return Q.top(rows, 25, F.desc("score"), F.desc("seq"), F.col("id")).select("id", "score")


@query("knowledge_budget", f"""WITH r AS (SELECT *, row_number() OVER w AS rank FROM {EVENTS_SQL} WHERE type IN ('skill', 'procedure', 'fact', 'latest_ingestion') WINDOW w AS (PARTITION BY type ORDER BY usage DESC, attention DESC, seq DESC, id) QUALIFY rank <= 20),
    s AS (SELECT *, sum(bytes) OVER (PARTITION BY type ORDER BY rank) AS run FROM r),
    a AS (SELECT id, type, rank, run FROM s WHERE type = 'skill' AND run <= 2400),
    b AS (SELECT id, type, rank, run FROM s WHERE type = 'procedure' AND run <= 2400 - (SELECT coalesce(max(run), 0) FROM a)),
    c AS (SELECT id, type, rank, run FROM s WHERE type = 'fact' AND run <= 2400 - (SELECT coalesce(max(run), 0) FROM a) - (SELECT coalesce(max(run), 0) FROM b)),
    d AS (SELECT id, type, rank, run FROM s WHERE type = 'latest_ingestion' AND run <= 2400 - (SELECT coalesce(max(run), 0) FROM a) - (SELECT coalesce(max(run), 0) FROM b) - (SELECT coalesce(max(run), 0) FROM c))
    SELECT id, type, rank FROM (FROM a UNION ALL FROM b UNION ALL FROM c UNION ALL FROM d)""")
def knowledge_budget(spark, sf_dir):
    return K.budget_per_type(events(spark, sf_dir), 20, 2400).select("id", "type", F.col("rank").cast("long").alias("rank"))


@query("knowledge_dedupe", f"SELECT id, type FROM {EVENTS_SQL} QUALIFY row_number() OVER (PARTITION BY type, coalesce(name, summary, text) ORDER BY seq DESC) = 1")
def knowledge_dedupe(spark, sf_dir):
    return K.deduped(events(spark, sf_dir)).select("id", "type")


@query("knowledge_compact", f"SELECT string_agg(left(text, 500), ' | ' ORDER BY attention DESC, seq) AS summary FROM (SELECT * FROM {EVENTS_SQL} ORDER BY attention DESC, seq LIMIT 5)")
def knowledge_compact(spark, sf_dir):
    return K.compact_summary(events(spark, sf_dir))


@query("knowledge_normalise", f"SELECT id, left(trim(coalesce(summary, name, text), ' '), 2000) AS text, coalesce(type, 'fact') AS type FROM {EVENTS_SQL}")
def knowledge_normalise(spark, sf_dir):
    return K.normalised(events(spark, sf_dir).withColumn("text", F.coalesce("summary", "name", "text"))).select("id", "text", "type")


@query("learn_skills", "SELECT CAST(p_partkey AS BIGINT) AS id, 'Pack ' || p_name || '.' AS name, 'open ' || p_type || '|close ' || p_brand AS steps FROM part")
def learn_skills(spark, sf_dir):
    text = F.concat(F.lit("- Pack "), "p_name", F.lit(". Then rest.\n\nSee below\n"), F.lit("1. open "), "p_type", F.lit("\n2) close "), "p_brand")
    rows = K.skills(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), text.alias("text")))
    return rows.select("id", "name", F.array_join(F.slice("steps", 2, 10), "|").alias("steps"))


COST_SQL = f"(SELECT id AS pos, CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN 2 ELSE 3 END AS grp, greatest(1, CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 4 / 3) AS BIGINT)) AS cost FROM {PHRASES_SQL})"


@query("token_budget", f"""WITH s AS (SELECT *, sum(cost) OVER (PARTITION BY grp ORDER BY pos) AS run FROM {COST_SQL}),
    a AS (SELECT grp, pos, cost, run FROM s WHERE grp = 1 AND run <= 3000),
    b AS (SELECT grp, pos, cost, run FROM s WHERE grp = 2 AND run <= 3000 - (SELECT coalesce(max(run), 0) FROM a)),
    c AS (SELECT grp, pos, cost, run FROM s WHERE grp = 3 AND run <= 3000 - (SELECT coalesce(max(run), 0) FROM a) - (SELECT coalesce(max(run), 0) FROM b))
    SELECT grp, pos, cost FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""")
def token_budget(spark, sf_dir):
    rows = phrases(spark, sf_dir).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 2).otherwise(3).alias("grp"), F.col("id").alias("pos"), T.token_estimate(F.col("text")).alias("cost"))
    return Q.budgeted(rows, 3000)


@query("related_chunks", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_''-]+') AS w FROM documents), c AS (SELECT doc_id, CAST(i // 140 AS BIGINT) AS id, list_distinct(list_filter(string_split_regex(lower(array_to_string(w[i+1:i+180], ' ')), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 3)) AS terms FROM (SELECT doc_id, w, unnest(range(0, len(w), 140)) AS i FROM w))
    SELECT a.doc_id, a.id AS a, b.id AS b, round(len(list_intersect(a.terms, b.terms)) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))), 6)::DOUBLE AS weight, row_number() OVER (PARTITION BY a.doc_id ORDER BY weight DESC, a.id, b.id) AS rank
    FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.id < b.id WHERE len(list_intersect(a.terms, b.terms)) > 0 AND round(len(list_intersect(a.terms, b.terms)) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))), 6) >= 0.18 QUALIFY rank <= 40""")
def related_chunks(spark, sf_dir):
    own = F.transform(T.chunks(F.col("text")), lambda c: F.struct(F.floor(c["start"] / 140).alias("id"), T.keywords(F.array_join(c["words"], " ")).alias("terms")))
    pairs = T.bound(own, lambda chunks: I.related(chunks))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pairs).alias("rank", "p"))
    return rows.select("doc_id", "p.a", "p.b", "p.weight", (F.col("rank") + 1).cast("long").alias("rank"))


@query("cross_memory", r"""WITH m AS (SELECT conv_id, CAST(conv_id * 100 + turn AS BIGINT) AS id, turn, conv_id % 7 AS task, role, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 3)) AS k, list_distinct(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{Lu}[\p{L}\p{N}_]+'))) AS e FROM conversations),
    p AS (SELECT a.conv_id AS root_id, a.id AS source_id, b.id AS target_id, len(list_intersect(a.k, b.k)) AS ki, len(a.k) + len(b.k) AS kn, len(list_intersect(a.e, b.e)) AS ei, len(a.e) + len(b.e) AS en, CASE WHEN a.role = b.role THEN 1 ELSE 0 END AS c, CASE WHEN a.task = b.task THEN 0.12 ELSE 0 END AS t FROM m a JOIN m b ON a.conv_id <> b.conv_id WHERE a.turn = 0)
    SELECT root_id, source_id, target_id, round(least(1.0, greatest(ki / greatest(1, kn - ki), ei / greatest(1, en - ei)) + 0.25 * c + t), 6)::DOUBLE AS weight FROM p WHERE ki + ei + c > 0 AND weight >= 0.24 QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY weight DESC, source_id, target_id) <= 20""")
def cross_memory(spark, sf_dir):
    """Links from each conversation's first turn to turns of others: keywords, entities, categories (here the role) and task."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("id"), F.col("conv_id").alias("root_id"), (F.col("conv_id") % 7).cast("string").alias("task_id"), T.keywords(F.col("text")).alias("keywords"), T.entities(F.col("text")).alias("entities"), F.array("role").alias("categories"), "turn")
    return I.cross_links(rows.filter("turn = 0"), rows).select("root_id", "source_id", "target_id", "weight")


@query("same_entity", "SELECT lower(p_brand) AS canonical, min(CAST(p_partkey AS BIGINT)) OVER (PARTITION BY p_brand) AS source_id, CAST(p_partkey AS BIGINT) AS target_id FROM part QUALIFY source_id < target_id")
def same_entity(spark, sf_dir):
    return I.same_entity(table(spark, sf_dir, "part").select(F.lower("p_brand").alias("canonical"), F.col("p_partkey").cast("long").alias("id")))


@query("event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def event_props(spark, sf_dir):
    """A key of structured payloads, read without a fixed schema."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k IS NOT NULL")


@query("signal_routing", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN 'task:' || user_id WHEN event_id % 4 = 2 THEN 'task' ELSE 'chat' END AS lane FROM events")
def signal_routing(spark, sf_dir):
    m = F.col("event_id") % 4
    lane = S.route(F.when(m == 0, F.col("event_type")), F.when(m == 1, F.col("user_id").cast("string")), F.when(m == 2, F.lit("task")).otherwise("other"))
    return table(spark, sf_dir, "events").select("event_id", lane.alias("lane"))


@query("streaming_status", f"SELECT id, max_by(family, seq) AS status, max(seq) AS seq FROM {LOG_SQL} GROUP BY id")
def streaming_status(spark, sf_dir):
    e = S.read_events(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return S.drain(S.running_status(e), "complete", ["id"])


@query("streaming_lifecycle", f"SELECT memory_id, list_reduce(['none'] || list(state ORDER BY seq), lambda a, s: CASE WHEN {GOES_SQL} THEN s ELSE a END) AS state FROM {MOVE_SQL} GROUP BY memory_id")
def streaming_lifecycle(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "view", "short_term").when(kind == "click", "promoted").when(kind == "signup", "candidate").when(kind == "purchase", "stale").otherwise(F.when(F.col("event_id") % 3 == 0, "contradicted").otherwise("pinned"))
    m = S.read_events(spark, sf_dir, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).cast("long").alias("memory_id"), F.col("event_id").alias("seq"), state.alias("state"))
    return S.drain(S.lifecycle(m), "update", ["memory_id"])


@query("streaming_idempotent", f"SELECT dedupe_key, seq, digest FROM {LOG_SQL} QUALIFY lag(digest) OVER (PARTITION BY dedupe_key ORDER BY seq) IS DISTINCT FROM digest")
def streaming_idempotent(spark, sf_dir):
    e = S.read_events(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("dedupe_key"), F.col("event_id").alias("seq"), F.md5("props").alias("digest"))
    return S.drain(S.idempotent(e), "append", ["dedupe_key"])


@query("streaming_facts")
def streaming_facts(spark, sf_dir):
    """What statements of facts lead to as they come in; events stand for statements, their type for the value."""
    e = S.read_events(spark, sf_dir, "events")
    told = e.select(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(":status")).alias("fact_key"), F.col("event_id").alias("seq"), F.lit("claim").alias("kind"), F.col("event_id").cast("string").alias("memory_id"), F.col("event_type").alias("value"), F.lit("short_term").alias("state"))
    return S.drain(S.facts(told), "append", ["fact_key"])


@query("streaming_lanes", "SELECT event_id, event_type AS lane, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events")
def streaming_lanes(spark, sf_dir):
    """Each lane's events in order, numbered one by one."""
    e = S.read_events(spark, sf_dir, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("seq"))
    return S.drain(S.lanes(e), "append", ["lane"]).select(F.col("seq").alias("event_id"), "lane", "place")
