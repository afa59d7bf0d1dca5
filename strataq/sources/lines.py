"""Text files of ``PREFIX: text`` lines as typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """type (lower-cased prefix, or text), text and source of every line that is not blank or a comment."""
    lines = spark.read.text(path).withColumn("source", F.input_file_name()).withColumn("value", F.trim("value"))
    lines = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", r":\s*", 2)
    has = F.col("value").rlike(r"^[A-Za-z_]+:\s*\S")
    return lines.select(F.when(has, F.lower(parts[0])).otherwise("text").alias("type"), F.when(has, parts[1]).otherwise(F.col("value")).alias("text"), "source")
