"""A corpus pipeline: five stages over documents, each written before the next reads it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  Rows whose key is null are judged like others, belong
to no group of near duplicates and lose no repeats, and null texts are empty.  Of rows
that repeat key and text entirely one stays; different texts of one key are rows of
their own, but never lose passages to each other.  Extra columns, whatever their names,
pass through all but the last stage.  Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataq.llm.jaccard import near_duplicates
from strataq.llm.langid import UNKNOWN, identify_language
from strataq.llm.nbsvm import quality_scores
from strataq.llm.packing import pack
from strataq.llm.queries import WORD_VOCAB, vocab_file
from strataq.llm.shared import checkpoint_folder
from strataq.llm.suffixes import remove_repeats
from strataq.sessions import remove_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores 0.3 or more; it learns from ``labels``."""
    scored = quality_scores(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(F.col("score") >= 0.3).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in a known language and sets ``lang`` to it; learns from the rows' own ``lang``."""
    out = identify_language(docs, docs).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5))
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the least key.

    Texts of one key are told apart by a hash, so that a text goes only if one like it
    stays; of rows that repeat key and text, one stays (a null text is empty).  Rows
    without a key all stay.
    """
    mark = "_row"
    while mark in docs.columns:
        mark += "_"
    groups = near_duplicates(docs, rows=True).filter((F.col("doc_id") != F.col("component_id")) | (F.col("row") != F.col("component_row")))
    groups = groups.select("doc_id", F.col("row").alias(mark)).distinct()
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = marked.filter(F.col("doc_id").isNotNull()).join(groups, ["doc_id", mark], "left_anti").dropDuplicates(["doc_id", mark])
    return keyed.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that an earlier document holds; documents left without text go."""
    return cut_repeats(docs).filter(F.col("text") != "")


def cut_repeats(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs, pass_through=[c for c in docs.columns if c not in ("doc_id", "text")])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 ids."""
    return pack(docs, vocab_file(WORD_VOCAB))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicate), ("repeats", repeats), ("packing", packing)]
#: Learned models, components and tokenizers are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared folder and read again.

    A stage's folder goes when the next one is written; the last stays, for the result is read from it.
    """
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
