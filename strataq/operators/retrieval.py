"""Ranked retrieval: BM25, hybrid scores, fusion, budgets.

A cue has few terms, so term frequencies are counted only for them, inside one
scan; corpus statistics are one global aggregate.  Nothing is exploded or shuffled
but the aggregate's single rows and the top-k.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataq.functions import text as T
from strataq.functions import vectors as V
from strataq.functions.predicates import boost, visible
from strataq.sessions import cut

K1, B = 1.4, 0.75


def cue_terms(cue: str, least: int = 2) -> list[str]:
    """Distinct terms of a cue, in order; the driver's twin of T.terms."""
    seen = dict.fromkeys(w for w in re.split(r"[^\w]+", cue.lower()) if len(w) >= least)
    return list(seen)


def cue_fingerprint(cue: str) -> int:
    """The driver's twin of T.simhash."""
    words = [w for w in re.split("[^a-z0-9_]+", cue.lower()) if len(w) >= 3] or [cue]
    hashes = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    return sum(1 << i for i in range(32) if 2 * sum(h >> i & 1 for h in hashes) >= len(hashes))


def with_frequencies(docs: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Adds _len, the number of terms, and _tf, an array with the frequency of every cue term.

    A text is read twice by a pattern, whatever comes after: ``inline`` keeps filters and
    aggregates from computing the two columns again.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    length = F.regexp_count(low, F.lit(r"[\p{L}\p{N}_]{2,}"))
    if not terms:
        return docs.select("*", length.alias("_len"), F.array().cast("array<int>").alias("_tf"))
    own = F.regexp_extract_all(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(map(re.escape, terms))})(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    tf = T.bound(own, lambda hits: F.array(*[F.size(F.filter(hits, _is(t))) for t in terms]))
    return docs.select("*", F.inline(F.array(F.struct(length.alias("_len"), tf.alias("_tf")))))


def _is(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, cue: str, text: str = "text") -> DataFrame:
    """Adds ``bm25`` (k1 1.4, b 0.75, average length at least 1) and ``exact``, the number of cue terms present.

    Statistics cover all rows of ``docs``; filter partitions afterwards.
    """
    terms = cue_terms(cue)
    rows = with_frequencies(docs, text, terms)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col("_tf")[i] > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    n, avg = stats["n"], max(1.0, stats["avg"] or 1.0)
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        df = stats[f"d{i}"]
        tf = F.col("_tf")[i].cast("double")
        idf = F.log(F.lit(1.0 + (n - df + 0.5) / (df + 0.5)))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / avg))).otherwise(0.0)
    exact = F.size(F.filter("_tf", lambda x: x > 0))
    return rows.withColumn("bm25", score).withColumn("exact", exact).drop("_tf", "_len")


def hybrid(docs: DataFrame, cue: str, text: str = "text", state: str = "state", vector: Sequence[float] | None = None) -> DataFrame:
    """BM25, phrase, exact and lifecycle scores of all visible rows, where their sum is positive; with a cue's vector, that of the column ``vector`` too.

    Hidden rows leave before statistics are taken.  The lifecycle boost is added
    before the test, so boosted rows show up for any cue.
    """
    rows = bm25(docs.filter(visible(F.col(state))), cue, text)
    phrase = F.when(F.lit(cue != "") & F.contains(F.lower(F.col(text)), F.lit(cue.lower())), 4.0).otherwise(0.0)
    total = F.col("bm25") + phrase + 1.5 * F.col("exact") + boost(F.col(state)) + _semantic(vector)
    return rows.withColumn("phrase", phrase).withColumn("score", total).filter("score > 0")


def _semantic(vector: Sequence[float] | None, otherwise: Column | None = None) -> Column:
    """The vector score of rows that have a vector, if the cue has one."""
    none = F.lit(0.0) if otherwise is None else otherwise
    if vector is None:
        return none
    cue = F.array(*[F.lit(float(x)) for x in vector])
    return F.when(F.col("vector").isNotNull(), V.vector_score(F.col("vector"), cue)).otherwise(none)


def fingerprint_score(fingerprint: Column, cue: str) -> Column:
    """Four times the similarity of fingerprints, if it is 0.62 or more."""
    like = 1 - T.hamming(fingerprint, F.lit(cue_fingerprint(cue)).cast("long")) / 32
    return F.when(like >= 0.62, 4 * like).otherwise(0.0)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a total order, with their rank from 1; the window sees k rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """All rows of a total order with their rank from 1: rows are sorted by range and counted by partition, not in one task."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")))
    before, starts = 0, []
    for p, n in sorted(rows.groupBy("_p").count().collect()):  # one row for each partition
        starts += [F.lit(p), F.lit(before)]
        before += n
    if not starts:
        return rows.drop("_p", "_i").withColumn("rank", F.lit(1).cast("long"))
    return rows.withColumn("rank", (F.create_map(*starts)[F.col("_p")] + F.col("_i") + 1).cast("long")).drop("_p", "_i")


def fuse(lists: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (key, rank) lists; rows without a key go."""
    rows = lists[0].select(key, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select(key, "rank"))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def budgeted(groups: DataFrame, budget: int) -> DataFrame:
    """Of (grp, pos, cost) rows, those that fit: group by group in order, each stopping at its first misfit.

    An item larger than the budget is taken only while nothing is.  Costs are at least 1,
    so a prefix that fits has no more rows than the budget: of each group, the window need
    not see the others.  What is used carries over from group to group; a group's part of
    it depends on how much the groups before it have left, so that the fold over groups
    goes over the running sums of each, which are bounded by the budget.
    """
    w = Window.partitionBy("grp").orderBy("pos")
    rows = groups.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(budget, 1))
    rows = rows.withColumn("_sum", F.sum("cost").over(w)).filter((F.col("_sum") <= budget) | (F.col("_n") == 1))
    sums = rows.groupBy("grp").agg(F.sort_array(F.collect_list("_sum")).alias("_sums"))
    used = lambda a: F.coalesce(a["used"], F.lit(0).cast("long"))

    def step(a: Column, g: Column) -> Column:
        left = budget - used(a)
        fits = F.coalesce(F.array_max(F.filter(g["_sums"], lambda s: s <= left)), F.lit(0).cast("long"))
        first = F.get(g["_sums"], F.lit(0))
        over = (used(a) == 0) & (first > budget)
        take = F.when(over, first).otherwise(fits)
        return F.struct((used(a) + take).alias("used"), F.concat(a["takes"], F.array(F.struct(g["grp"].alias("grp"), take.alias("take")))).alias("takes"))

    kind = f"array<struct<grp:{groups.schema['grp'].dataType.simpleString()},take:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("takes"))
    # A sum or two for each group, in order.
    folded = sums.agg(F.aggregate(F.sort_array(F.collect_list(F.struct("grp", "_sums"))), start, step).alias("_f")).select(F.inline("_f.takes"))
    return rows.join(F.broadcast(folded), "grp").filter(F.col("_sum") <= F.col("take")).drop("_n", "_sum", "take")


def active_scores(moments: DataFrame, cue: str, text: str = "text", vector: Sequence[float] | None = None) -> DataFrame:
    """Two for each shared keyword, three for each shared entity, two for a status question about a task; attention is added to matches.

    Rows with keywords, entities, vectors or fingerprints of their own are scored by
    these: a vector by cosine and sign bits, a row without one by its fingerprint.
    """
    keys = cue_terms(cue, 3)
    names = list(dict.fromkeys(w for w in re.split(r"[^\w]+", cue) if len(w) >= 2 and w[0].isupper()))
    own = lambda name, made: F.coalesce(F.col(name), made) if name in moments.columns else made
    shared = lambda have, want: F.size(F.array_intersect(have, F.array(*[F.lit(x) for x in want]))) if want else F.lit(0)
    status = F.lit(2 if "how" in cue.lower() and "going" in cue.lower() else 0)
    alike = F.lit(0.0)
    if "fingerprint" in moments.columns and keys:
        alike = F.coalesce(fingerprint_score(F.col("fingerprint"), cue), F.lit(0.0))
    if "vector" in moments.columns:
        alike = _semantic(vector, alike)
    match = 2 * shared(own("keywords", T.keywords(F.col(text))), keys) + 3 * shared(own("entities", T.entities(F.col(text))), names) + alike + F.when(F.col("task_id").isNotNull(), status).otherwise(0)
    return moments.withColumn("match", match).withColumn("score", F.when(F.col("match") > 0, F.col("match") + F.col("attention")).otherwise(0.0)).filter("score > 0")
