"""Quality rules as a learned decision list, in DataFrame functions only.

Sequential covering on labelled statistics: a rule starts empty, grows by the
threshold test with the best information gain on a growing set, is pruned from its
end on a separate set, and is kept while it stays precise there; rows it covers go
and the next rule is learned.  The list becomes one ordered ``when`` expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

WHITE = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols_per_word", "repeat_share", "dup_line_share", "mean_word", "upper_share", "exclaims_per_word", "bars_per_word", "distinct_share")
Test = tuple[str, str, float]


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Sorting windows by hash and place brings equal ones together; the words of
    neighbours are then compared themselves.  Only different windows with one 64-bit
    hash that are each repeated could hide each other.
    """
    n = F.size(hashes)
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        equal = x["h"] == y["h"]
        for k in range(3):
            equal = equal & (F.get(words, x["i"] + k) == F.get(words, y["i"] + k))
        return F.coalesce(equal, F.lit(False))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        return F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    # One-element arrays bind a value once, as a let.
    bound = F.transform(F.transform(F.array(placed), covered), total)
    return F.when((n > 1) & (F.size(F.array_distinct(hashes)) < n), F.get(bound, F.lit(0))).otherwise(F.lit(0)).cast("long")


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts (long) and the features (double) of every whole text.

    A null text has no words.  Columns already named like the results are replaced.
    """
    df = df.drop(*BASE, *FEATURES)
    kept = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__words", F.array_remove(F.split(t, WHITE), ""))
    words = F.col("__words")
    df = df.withColumn("__hashes", F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.col("n_words")
    df = df.select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(words, F.col("__hashes")).alias("n_repeat_words"),
        F.size("__lines").cast("double").alias("__n_lines"),
        F.size(F.array_distinct("__words")).cast("double").alias("__n_distinct"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("double").alias("__n_upper"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("double").alias("__n_exclaims"),
        (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).cast("double").alias("__n_bars"),
    )
    per = {
        "symbols_per_word": (F.col("n_symbols"), n),
        "repeat_share": (F.col("n_repeat_words"), n),
        "dup_line_share": (F.col("n_dup_lines"), F.col("__n_lines")),
        "mean_word": (F.col("word_chars"), n),
        "upper_share": (F.col("__n_upper"), F.col("word_chars")),
        "exclaims_per_word": (F.col("__n_exclaims"), n),
        "bars_per_word": (F.col("__n_bars"), n),
        "distinct_share": (F.col("__n_distinct"), n),
    }
    return df.withColumns({k: a.cast("double") / F.greatest(b, F.lit(1)).cast("double") for k, (a, b) in per.items()}).drop("__n_lines", "__n_distinct", "__n_upper", "__n_exclaims", "__n_bars")


def _covers(x: dict[str, np.ndarray], rule: Sequence[Test], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, op, cut in rule:
        out &= x[name] >= cut if op == ">=" else x[name] <= cut
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int, cuts: dict[str, np.ndarray]) -> list[Test]:
    rule: list[Test] = []
    on = np.ones(len(bad), bool)
    while len(rule) < longest and (on & ~bad).any():
        p0, n0 = (on & bad).sum(), (on & ~bad).sum()
        base = np.log2(p0 / (p0 + n0))
        best: tuple[float, Test | None, np.ndarray] = (0.0, None, on)
        for name, edges in cuts.items():
            for cut in edges:
                for op in (">=", "<="):
                    now = on & (x[name] >= cut if op == ">=" else x[name] <= cut)
                    p, m = int((now & bad).sum()), int((now & ~bad).sum())
                    if p and (gain := p * (np.log2(p / (p + m)) - base)) > best[0] + 1e-9:
                        best = gain, (name, op, float(cut)), now
        if best[1] is None:
            break
        rule.append(best[1])
        on = best[2]
    return rule


def learn_rules(rows: Sequence[Sequence[float]], bad: Sequence[bool], features: Sequence[str] = FEATURES, longest: int = 3, most_rules: int = 12, precision: float = 0.95, least: int = 3, cuts: int = 24) -> list[list[Test]]:
    """Ordered conjunctions that say which rows are bad; none if no rule is precise enough on the pruning rows."""
    if not len(rows):
        return []
    data, y = np.array(rows, float), np.array(bad, bool)
    x = {f: data[:, i] for i, f in enumerate(features)}
    prune = np.arange(len(y)) % 3 == 2
    left = np.ones(len(y), bool)
    rules: list[list[Test]] = []
    while len(rules) < most_rules:
        g, q = left & ~prune, left & prune
        if y[g].sum() < least or y[q].sum() < 1:
            break
        xg, xq = {f: v[g] for f, v in x.items()}, {f: v[q] for f, v in x.items()}
        edges = {f: np.unique(np.quantile(v[y[g]], np.linspace(0, 1, cuts))) for f, v in xg.items()}
        rule = _grow(xg, y[g], longest, edges)
        if not rule:
            break

        def worth(r: Sequence[Test]) -> float:
            c = _covers(xq, r, int(q.sum()))
            p, m = int((c & y[q]).sum()), int((c & ~y[q]).sum())
            return (p - m) / (p + m) if p + m else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covers(x, rule, len(y)) & left
        hit, miss = int((c & y & prune).sum()), int((c & ~y & prune).sum())
        all_hit, all_miss = int((c & y).sum()), int((c & ~y).sum())
        if hit < 1 or hit < precision * (hit + miss) or all_hit < max(least, precision * (all_hit + all_miss)):
            break
        rules.append(rule)
        left &= ~c
    return rules


def rule_expression(rules: Sequence[Sequence[Test]]) -> Column:
    """The number of the first rule that fires, or null."""
    out: Column | None = None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for name, op, cut in rule:
            test = test & (F.col(name) >= F.lit(cut) if op == ">=" else F.col(name) <= F.lit(cut))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def fit_rules(df: DataFrame, labels: DataFrame, most_rows: int = 5000, key_column: str = "doc_id", text: str = "text", label: str = "quality") -> list[list[Test]]:
    """Learns the list from about ``most_rows`` labelled documents, chosen by a hash of the key."""
    labels = labels.filter(F.col(label).isNotNull() & F.col(key_column).isNotNull()).select(key_column, F.col(label).cast("int").alias("_label"))
    n = labels.count()
    chance = F.pmod(F.xxhash64(F.col(key_column), F.lit("rules")), F.lit(1 << 40)) / float(1 << 40)
    chosen = labels.filter(chance < min(1.0, most_rows / max(1, n))).groupBy(key_column).agg(F.max("_label").alias("_label"))
    found = text_statistics(df.select(key_column, text).join(F.broadcast(chosen), key_column), text)
    rows = found.filter("n_words > 0").select(F.col(key_column).cast("string"), (F.col("_label") == 0), *FEATURES).collect()
    rows = sorted(rows, key=lambda r: (hash_order(r[0]), r[0]))
    return learn_rules([r[2:] for r in rows], [r[1] for r in rows])


def hash_order(key: str) -> int:
    import zlib

    return zlib.crc32(key.encode())


def apply_rules(df: DataFrame, rules: Sequence[Sequence[Test]], text: str = "text") -> DataFrame:
    """Adds statistics, ``base_failed``, ``rule`` (which one fired, or null) and ``kept``.

    Texts without words (null and empty ones too) fail the base test.
    """
    out = text_statistics(df, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("rule", rule_expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
