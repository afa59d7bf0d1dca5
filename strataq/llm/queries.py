"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BYTE_VOCAB, WORD_VOCAB = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocab_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; rows are told apart by it for training and testing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % parts


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), vocab_file(BYTE_VOCAB))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.rules import BASE, apply_rules, fit_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.langid import identify_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(4) == 2)
    out = identify_language(docs.drop("lang"), docs.filter(~F.col("held_out")))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.nbsvm import quality_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(5) == 0)
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    out = quality_scores(docs, docs, labels)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocab_file(WORD_VOCAB))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.suffixes import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.edits import edited_token_counts

    return edited_token_counts(table(spark, sf_dir, "documents"), vocab_file(BYTE_VOCAB))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataq.llm.sharding import hilbert_shards

    out = hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_rules": op2_rules,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language": op4_language,
    "op5_top_k": op5_top_k,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_repeats": op8_repeats,
    "op9_token_counts": op9_token_counts,
    "op10_sharding": op10_sharding,
}

ORACLES: dict[str, str] = {
    "op3_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
            FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), c AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)
        ), e AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (
            SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a
        ), m AS (
            SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
    """,
    "op8_repeats": """
        WITH b AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), p AS (
            SELECT doc_id, u.p AS p, u.s AS s
            FROM (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2), lambda i: {'p': i, 's': substr(h, 2 * i + 1, 100)})) AS u FROM b)
        ), f AS (
            SELECT s, min(doc_id) AS d FROM p WHERE length(s) = 100 GROUP BY s
        ), k AS (
            SELECT p.doc_id, p.p, left(p.s, 2) AS byte, max(CASE WHEN f.d < p.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
            FROM p LEFT JOIN f ON f.s = p.s
        ), g AS (
            SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM k
        ), t AS (
            SELECT doc_id, count(*) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (gone = 0) AS kept
            FROM g GROUP BY doc_id
        )
        SELECT b.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM b LEFT JOIN t ON t.doc_id = b.doc_id
    """,
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
        QUALIFY rank <= 5
    """,
}
