"""The append-only log: replay, idempotence, tombstones, compaction.

Rows have family, id, dedupe_key, seq (their place in the log), digest and payload
columns.  Latest-per-key is an aggregate with map-side combining, not a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(log: DataFrame, key: str = "dedupe_key", seq: str = "seq") -> DataFrame:
    """The last row of every key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), seq).alias("_r")).select("_r.*")


def changed(log: DataFrame, key: str = "dedupe_key", seq: str = "seq", digest: str = "digest", before: DataFrame | None = None, block: int = 1 << 24) -> DataFrame:
    """Rows whose digest differs from the one before them of their key: A, A, B, A gives A, B, A.

    ``before`` has the last digest of keys that were written earlier.  A key's rows are
    compared within blocks of the sequence, and the first of a block with the last of the
    blocks before it, so that a key with very many rows doesn't fill one task.
    """
    inner, outer = Window.partitionBy(key, "_b").orderBy(seq), Window.partitionBy(key).orderBy("_b")
    rows = log.withColumn("_b", F.floor(F.col(seq) / block))
    ends = rows.groupBy(key, "_b").agg(F.max_by(digest, seq).alias("_end")).withColumn("_prior", F.lag("_end").over(outer)).drop("_end")
    if before is not None:
        ends = ends.join(before.select(key, F.col(digest).alias("_last")), key, "left").select(key, "_b", F.coalesce("_prior", "_last").alias("_prior"))
    out = rows.join(ends, [key, "_b"]).withColumn("_before", F.coalesce(F.lag(digest).over(inner), "_prior"))
    return out.filter(~F.col("_before").eqNullSafe(F.col(digest))).select(*log.columns)


def without_tombstones(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Tombstones have no time: they hide an id of a family wherever it stands, but only in their own namespace and scope, where they have these columns."""
    t = tombstones.distinct()
    same = [t[c].eqNullSafe(log[c]) if c == "scope" else t[c] == log[c] for c in ("namespace", "scope", "family", "id") if c in t.columns]
    return log.join(t, same, "left_anti")


def compacted(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What a physical compaction keeps."""
    return without_tombstones(latest(log), tombstones)


def strongest(log: DataFrame, priority: Column, limit: int = 1000) -> DataFrame:
    """Rows for semantic compaction: highest priority, then oldest."""
    return log.withColumn("priority", F.coalesce(priority, F.lit(0.0))).orderBy(F.desc("priority"), "seq").limit(limit)


def newest(rows: DataFrame, partition: list[str], keep: int, seq: str = "seq") -> DataFrame:
    """The newest rows of each partition.  Spark keeps only ``keep`` rows of a partition in each task before it shuffles (WindowGroupLimit)."""
    w = Window.partitionBy(*partition).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")
