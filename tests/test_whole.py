"""Queries that once left out rows: all of a table's rows count."""

import hashlib
import re

import pytest

from strataq.operators import graph as R
from strataq.operators import observations as O
from strataq.operators import retrieval as Q
from strataq.plans.all import QUERIES
from strataq.plans.text_queries import phrases


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def fingerprint(text):
    tokens = [t for t in re.split("[^a-z0-9_]+", text.lower()) if len(t) >= 3] or [text]
    hashes = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in tokens]
    return sum(1 << i for i in range(32) if sum(1 if h >> i & 1 else -1 for h in hashes) >= 0)


def long_and_short():
    words = " ".join(f"word{i * i % 97}" for i in range(900))
    return [(1, "a short memory"), (2, words), (3, words + " more"), (4, "x" * 1500), (5, "other words of no kin")]


def test_simhash_takes_long_texts(spark, tmp_path):
    docs = long_and_short()
    assert max(len(t) for _, t in docs) > 5000
    sf = put(spark, tmp_path, "documents", docs, "doc_id long, text string")
    assert dict(QUERIES["simhash"](spark, sf).collect()) == {i: fingerprint(t) for i, t in docs}


def test_fingerprint_match_takes_long_texts(spark, tmp_path):
    docs = long_and_short()[1:]  # the cue is a long text
    sf = put(spark, tmp_path, "documents", docs, "doc_id long, text string")
    like = {i: 1 - (fingerprint(t) ^ fingerprint(docs[0][1])).bit_count() / 32 for i, t in docs}
    want = {i: round(4 * x, 6) for i, x in like.items() if x >= 0.62}
    assert {2, 3} <= want.keys()
    assert dict(QUERIES["fingerprint_match"](spark, sf).collect()) == want


MOVES = {"click": 0.08, "view": -0.08, "error": -0.16}
TREND = {"click": "strengthening", "view": "weakening", "error": "contradicted"}


def verified(events):
    out = {}
    for seq, user, kind in sorted(events):
        p, c, x, _ = out.get(user, (1, 0, 0.5, ""))
        out[user] = (p + (kind == "click"), c + (kind in ("view", "error")), max(0.0, min(0.98, x + MOVES.get(kind, 0.0))), kind)
    return {u: (p, c, round(x, 6), TREND.get(k, "stable"), "contradicted" if c > p else "promoted" if p >= 2 else "candidate") for u, (p, c, x, k) in out.items()}


def some_events():
    kinds = ["click"] * 4 + ["view", "error", "purchase"]
    return [(i, 7 if i in (1, 2, 3) else i * i % 3, kinds[i * 5 % 7 if i < 60 else i * i % 7]) for i in range(120)]


def test_verify_observation_takes_every_event(spark, tmp_path):
    events = some_events()
    sf = put(spark, tmp_path, "events", events, "event_id long, user_id int, event_type string")
    got = {r["key"]: (r["proof_count"], r["contradiction_count"], r["confidence"], r["trend"], r["state"]) for r in QUERIES["verify_observation"](spark, sf).collect()}
    assert got == verified(events) and 7 in got


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_verified_by_blocks(spark, block):
    events = some_events()
    relation = {"click": "supports", "view": "weakens", "error": "contradicts"}
    checks = spark.createDataFrame([(u, i, relation.get(k, "neutral")) for i, u, k in events], "key int, seq long, relation string")
    start = spark.createDataFrame([(u, 1, 0, 0.5) for u in {u for _, u, _ in events}], "key int, proof_count long, contradiction_count long, confidence double")
    got = {r["key"]: (r["proof_count"], r["contradiction_count"], round(r["confidence"], 6), r["trend"], r["state"]) for r in O.verified(start, checks, block=block).collect()}
    assert got == verified(events)


def test_token_budget_takes_every_part(spark, tmp_path):
    parts = [(i, "a", "b", "c") for i in range(1, 1501)]  # costs are so small that the budget reaches past the 600th part
    sf = put(spark, tmp_path, "part", parts, "p_partkey int, p_name string, p_brand string, p_type string")
    cost = {r["id"]: max(1, len(r["text"].split()) * 4 // 3) for r in phrases(spark, sf).collect()}
    left, want = 3000, []
    for grp, rest in ((1, 0), (2, 1), (3, 2)):
        for i in range(1, 1501):
            if i % 3 == rest:
                if cost[i] > left:
                    break
                left -= cost[i]
                want.append((grp, i, cost[i]))
    assert max(i for _, i, _ in want) > 600
    got = sorted((r["grp"], r["pos"], r["cost"]) for r in QUERIES["token_budget"](spark, sf).collect())
    assert got == sorted(want)


@pytest.mark.parametrize("budget", [1, 3, 10])
def test_budget_of_cheapest_rows(spark, budget):
    rows = spark.createDataFrame([(1, i, 1) for i in range(20)], "grp int, pos int, cost long")
    assert sorted(r["pos"] for r in Q.budgeted(rows, budget).collect()) == list(range(budget))


def test_components_of_a_slow_graph(spark):
    """A chain 0, n - 1, n - 2 ... 1: the least label moves one step a round."""
    n = 8
    chain = [0, *range(n - 1, 0, -1)]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(chain, chain[1:]))], "id long, source_id long, target_id long")
    assert {r["component"] for r in R.components(nodes, edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        R.components(nodes, edges, most_rounds=2)
