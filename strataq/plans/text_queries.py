"""Text functions over documents and over phrases made from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataq.functions import text as T
from strataq.plans.registry import query, table

SPLIT = r"string_split_regex(lower(text), '[^\p{L}\p{N}_]+')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def counted(own, name: str) -> F.Column:
    """How many an array has, and its values in order; the array is worked out once."""
    row = lambda k: F.struct(F.size(k).cast("long").alias("n"), F.array_join(F.sort_array(k), " ").alias(name))
    return F.inline(F.array(T.bound(own, row)))


def count(c) -> F.Column:
    return F.size(c).cast("long")


@query("keywords", rf"SELECT doc_id, CAST(len(k) AS BIGINT) AS n, array_to_string(list_sort(k), ' ') AS words FROM (SELECT doc_id, list_distinct(list_filter({SPLIT}, lambda x: length(x) >= 3)) AS k FROM documents)")
def keywords(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", counted(T.keywords(F.col("text")), "words"))


@query("terms", rf"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter({SPLIT}, lambda x: length(x) >= 2)) AS term FROM documents) GROUP BY ALL")
def terms(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query("terms_ascii", "SELECT doc_id, CAST(len(k) AS BIGINT) AS n, array_to_string(list_sort(k), ' ') AS words FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 3)) AS k FROM documents)")
def terms_ascii(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", counted(T.ascii_terms(F.col("text")), "words"))


@query("entities_names", r"SELECT doc_id, CAST(len(k) AS BIGINT) AS n, array_to_string(list_sort(k), ' ') AS names FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{Lu}[\p{L}\p{N}_]+'))) AS k FROM documents)")
def entities_names(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", counted(T.entities(F.col("text")), "names"))


@query("words", r"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, array_to_string(w[1:5], ' ') AS head FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_''-]+') AS w FROM documents)")
def words(spark, sf_dir):
    row = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_join(F.slice(w, 1, 5), " ").alias("head"))
    return documents(spark, sf_dir).select("doc_id", F.inline(F.array(T.bound(T.words(F.col("text")), row))))


@query("summary_words", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_''-]+')[1:36], ' ') AS summary FROM documents")
def summary_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("key_points", r"SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])[ \t\n\f\r\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:3], '|') AS points FROM documents")
def key_points(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.key_points(F.col("text")), "|").alias("points"))


RULES_SQL = ", ".join(f"CASE WHEN list_has_any(w, {v.split()}) THEN '{k}' END" for k, v in T.CATEGORY_RULES.items())
PHRASES_SQL = """(
    SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 8
        WHEN 0 THEN 'We decided to ship ' || p_name || '. It often breaks; fix the module.'
        WHEN 1 THEN 'The user prefers ' || p_name || ' over ' || p_brand || '.'
        WHEN 2 THEN 'This agent often needs ' || p_name || '. The adapter must not fail.'
        WHEN 3 THEN 'Project direction is moving toward ' || p_type || '.'
        WHEN 4 THEN 'TODO: verify the API contract of ' || p_name
        WHEN 5 THEN 'user: the prompt for ' || p_name || ' is ready'
        WHEN 6 THEN '{"part": ' || p_partkey || '}'
        ELSE 'import ' || p_name || ' status is blocked by ' || p_brand || ';' END AS text
    FROM part)"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence or two for every part; kinds by the key modulo 8."""
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    made = [
        ("We decided to ship ", name, ". It often breaks; fix the module."),
        ("The user prefers ", name, " over ", brand, "."),
        ("This agent often needs ", name, ". The adapter must not fail."),
        ("Project direction is moving toward ", kind, "."),
        ("TODO: verify the API contract of ", name),
        ("user: the prompt for ", name, " is ready"),
        ('{"part": ', F.col("p_partkey").cast("string"), "}"),
        ("import ", name, " status is blocked by ", brand, ";"),
    ]
    text = F.lit(None).cast("string")
    for i, parts in enumerate(made):
        text = F.when(F.col("p_partkey") % 8 == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(text)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), text.alias("text"))


@query("categories", rf"SELECT id, array_to_string(CASE WHEN len(c) = 0 THEN ['note'] ELSE c END, ' ') AS labels FROM (SELECT id, list_filter([{RULES_SQL}], lambda x: x IS NOT NULL) AS c FROM (SELECT id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_''-]+'), lambda x: lower(x)) AS w FROM {PHRASES_SQL}))")
def categories(spark, sf_dir):
    return phrases(spark, sf_dir).select("id", F.array_join(T.chunk_categories(F.col("text")), " ").alias("labels"))


TECH_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{k}' END" for k, p in T.TECHNICAL_RULES.items())


@query("technical_priority", f"SELECT id, array_to_string(c, ' ') AS labels, CASE WHEN list_has_any(c, ['decision','bug','api_contract']) THEN 1.8 WHEN list_has_any(c, ['architecture','constraint','todo']) THEN 1.6 WHEN list_has_any(c, ['preference','project_state']) THEN 1.4 WHEN len(c) > 0 THEN 1.2 ELSE 1.0 END::DOUBLE AS priority FROM (SELECT id, list_filter([{TECH_SQL}], lambda x: x IS NOT NULL) AS c FROM {PHRASES_SQL})")
def technical_priority(spark, sf_dir):
    c = T.technical_categories(F.col("text"))
    return phrases(spark, sf_dir).select("id", F.array_join(c, " ").alias("labels"), T.technical_priority(c).alias("priority"))


KIND_SQL = r"""CASE
    WHEN (starts_with(text, '{') AND ends_with(text, '}')) OR (starts_with(text, '[') AND ends_with(text, ']')) THEN 'text'
    WHEN regexp_matches(text, '\b(defmodule|def |defp |function|class|import|const|let|var)\b') OR regexp_matches(text, '[{};]\s*$') THEN 'code'
    WHEN regexp_matches(text, '(?i)\b(todo|task|action item|next step|implement|verify)\b') THEN 'task'
    WHEN regexp_matches(text, '(?i)\b(user|assistant|system):') THEN 'chat'
    WHEN contains(lower(text), 'prompt') THEN 'prompt' ELSE 'text' END"""


@query("kind_inference", f"SELECT id, kind, CASE kind WHEN 'task' THEN 'planning' WHEN 'chat' THEN 'chat' WHEN 'prompt' THEN 'chat' WHEN 'code' THEN 'code_learning' ELSE 'memory' END AS stream FROM (SELECT id, {KIND_SQL} AS kind FROM {PHRASES_SQL})")
def kind_inference(spark, sf_dir):
    k = T.kind(F.col("text"))
    return phrases(spark, sf_dir).select("id", k.alias("kind"), T.stream_of(k).alias("stream"))


@query("title_line", r"SELECT doc_id, coalesce(left(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0B\f\r]'), lambda x: trim(x, ' ')), lambda x: x <> '')[1], 90), 'text memory') AS title FROM documents")
def title_line(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.title(F.col("text"), F.lit("text")).alias("title"))


@query("token_estimate", r"SELECT doc_id, greatest(1, CAST(floor(len(list_filter(string_split_regex(text, '[ \t\n\f\r\x0B]+'), lambda x: x <> '')) * 4 / 3) AS BIGINT)) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


FACTS_SQL = "(SELECT CAST(c_custkey AS BIGINT) AS id, 'Customer' || (c_custkey % 200) || CASE WHEN c_custkey % 3 = 0 THEN ' owner is ' ELSE ' status is ' END || c_mktsegment || '.' AS text FROM customer)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("id"), F.concat(F.lit("Customer"), (F.col("c_custkey") % 200).cast("string"), F.when(F.col("c_custkey") % 3 == 0, " owner is ").otherwise(" status is "), "c_mktsegment", F.lit(".")).alias("text"))


FACT_SQL = rf"(SELECT id, lower(regexp_extract(text, '(?i)\b([\p{{L}}\p{{N}}_''-]+)\s+(status|owner)\s+(?:is|=|:)\s+([^;\n]+)', 1)) AS subject, lower(regexp_extract(text, '(?i)\s(status|owner)\s+(?:is|=|:)', 1)) AS attribute, lower(regexp_replace(regexp_extract(text, '(?i)\s(?:status|owner)\s+(?:is|=|:)\s+([^;\n]+)', 1), '\.+$', '')) AS value FROM {FACTS_SQL})"


@query("fact_claims", f"SELECT id, subject || ':' || attribute AS fact_key, value FROM {FACT_SQL}")
def fact_claims(spark, sf_dir):
    return facts(spark, sf_dir).select("id", T.fact_claim(F.col("text")).alias("f")).filter("f IS NOT NULL").select("id", F.concat_ws(":", "f.subject", "f.attribute").alias("fact_key"), F.col("f.value").alias("value"))


CLAIM_ROWS_SQL = " UNION ALL ".join(
    f"SELECT id, '{t}' AS type, regexp_replace(regexp_replace(lower('{head}' || trim(b, ' ')), '\\.+$', ''), '\\s+', ' ', 'g') AS statement, {T.CLAIM_CONFIDENCE[t]}::DOUBLE AS confidence FROM (SELECT id, unnest(regexp_extract_all(text, '(?i){p}', 1)) AS b FROM p)" for t, p, head in T.CLAIM_PATTERNS
)
CLAIMS_SQL = f"WITH p AS (SELECT * FROM {PHRASES_SQL}), c AS (SELECT DISTINCT * FROM ({CLAIM_ROWS_SQL})) SELECT id, type, statement, confidence FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.id = c.id AND o.type = c.type AND o.statement <> c.statement AND contains(o.statement, c.statement))"


@query("semantic_claims", CLAIMS_SQL)
def semantic_claims(spark, sf_dir):
    return phrases(spark, sf_dir).select("id", F.inline(T.claims(F.col("text"))))


@query("email_extract", r"SELECT doc_id, e AS email, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}')) AS e FROM documents) GROUP BY ALL")
def email_extract(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(T.emails(F.col("text"))).alias("email")).groupBy("doc_id", "email").agg(F.count(F.lit(1)).alias("n"))


@query("number_extract", r"SELECT id, array_to_string(regexp_extract_all(text, '\b\d+\b'), ' ') AS numbers FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, 'Order ' || o_orderkey || ' of customer ' || o_custkey || ' is ' || o_orderstatus AS text FROM orders)")
def number_extract(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "), F.col("o_custkey").cast("string"), F.lit(" is "), "o_orderstatus")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), F.array_join(T.numbers(text), " ").alias("numbers"))


CALLS_SQL = "(SELECT CAST(n_nationkey AS BIGINT) AS id, n_name || ' called ' || r_name || ' on 2026-' || lpad(CAST(1 + n_nationkey % 12 AS VARCHAR), 2, '0') || '-10 and then paid' AS text FROM nation JOIN region ON n_regionkey = r_regionkey)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", F.lit(" called "), "r_name", F.lit(" on 2026-"), F.lpad((1 + F.col("n_nationkey") % 12).cast("string"), 2, "0"), F.lit("-10 and then paid")).alias("text"))


@query("event_extract", rf"SELECT id, regexp_extract(text, '\b([A-Z][A-Za-z0-9_''-]*)\s+(called)\s+([A-Z][A-Za-z0-9_''-]*)?', 1) AS actor, 'called' AS action, regexp_extract(text, '\b([A-Z][A-Za-z0-9_''-]*)\s+(called)\s+([A-Z][A-Za-z0-9_''-]*)?', 3) AS object FROM {CALLS_SQL}")
def event_extract(spark, sf_dir):
    return calls(spark, sf_dir).select("id", F.inline(T.events(F.col("text"))))


@query("iso_dates", rf"SELECT id, array_to_string(regexp_extract_all(text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), ' ') AS dates FROM {CALLS_SQL}")
def iso_dates(spark, sf_dir):
    return calls(spark, sf_dir).select("id", F.array_join(T.iso_dates(F.col("text")), " ").alias("dates"))


@query("month_dates", "SELECT CAST(n_nationkey AS BIGINT) AS id, strftime(make_date(2026, 1 + n_nationkey % 12, 10), '%Y-%m-%d') AS dates FROM nation")
def month_dates(spark, sf_dir):
    names = F.array(*[F.lit(g[i % len(g)]) for i, g in enumerate(T.MONTHS)])
    text = F.concat(F.lit("Seen 10 "), F.element_at(names, F.col("n_nationkey") % 12 + 1), F.lit(" 2026, not 31 febbraio 2026"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array_join(T.month_dates(text), " ").alias("dates"))


@query("named_entities", rf"SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9_''-]*\b'), lambda x: x NOT IN ({', '.join(repr(s) for s in T.STOP_ENTITIES)})))), ' ') AS names FROM {CALLS_SQL}")
def named_entities(spark, sf_dir):
    return calls(spark, sf_dir).select("id", F.array_join(F.sort_array(T.named_entities(F.col("text"))), " ").alias("names"))


SIMHASH_SQL = "list_reduce([0] || list_transform(range(0, 32), lambda i: CASE WHEN list_sum(list_transform(h, lambda x: CASE WHEN (x >> CAST(i AS INTEGER)) & 1 = 1 THEN 1 ELSE -1 END)) >= 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END), lambda a, b: a + b)"
FINGER_SQL = f"(SELECT doc_id, CAST({SIMHASH_SQL} AS BIGINT) AS fingerprint FROM (SELECT doc_id, list_transform(CASE WHEN len(t) = 0 THEN [text] ELSE t END, lambda x: CAST('0x' || left(md5(x), 8) AS BIGINT)) AS h FROM (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 3) AS t FROM documents)))"


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.simhash(F.col("text")).alias("fingerprint"))


@query("simhash", f"SELECT * FROM {FINGER_SQL}")
def simhash(spark, sf_dir):
    """Fingerprints of all memories, of any length."""
    return fingerprints(spark, sf_dir)


@query("chunk_windows", r"SELECT doc_id, CAST(i AS BIGINT) AS start, CAST(len(w[i+1:i+180]) AS BIGINT) AS n, w[i+1] AS first_word FROM (SELECT doc_id, w, unnest(range(0, len(w), 140)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_''-]+') AS w FROM documents))")
def chunk_windows(spark, sf_dir):
    c = documents(spark, sf_dir).select("doc_id", F.inline(T.chunks(F.col("text"))))
    return c.select("doc_id", F.col("start").cast("long").alias("start"), count("words").alias("n"), F.col("words")[0].alias("first_word"))
