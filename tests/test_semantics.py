"""Golden cases of the engine's semantics."""

import pytest
from pyspark.sql import functions as F

from strataq.functions import predicates as P
from strataq.functions import text as T
from strataq.functions import vectors as V
from strataq.operators import governance as G
from strataq.operators import graph as R
from strataq.operators import log as L
from strataq.operators import observations as O
from strataq.operators import retrieval as Q


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).first()["x"]


def test_claims_one_each(spark):
    texts = {
        "The user prefers simple Elixir-native architecture.": ("preference", "user prefers simple elixir-native architecture"),
        "The project direction is moving away from external services.": ("project_state", "project direction is moving away from external services"),
        "This agent often fails because it searches too broadly.": ("pattern", "agent often fails because it searches too broadly"),
        "We decided to keep persistence append-only for compatibility.": ("decision", "decided to keep persistence append-only for compatibility"),
    }
    for text, want in texts.items():
        assert [(c["type"], c["statement"]) for c in one(spark, text, T.claims)] == [want]


def test_fact_observation_counts(spark):
    texts = ["Alice email is alice@example.com", "Alice email is alice@example.com", "Alice email is old@example.com"]
    facts = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", T.fact_claim(F.col("text")).alias("f"))
    facts = facts.select("id", F.concat_ws(":", "f.subject", "f.attribute").alias("fact_key"), "f.*")
    got = {r["statement"]: r for r in O.fact_observations(facts).collect()}
    r = got["alice email is alice@example.com"]
    assert (r["proof_count"], r["contradiction_count"], r["state"], r["trend"], r["against_as"]) == (2, 1, "promoted", "weakening", "weakens")


def test_chunks_go_on_until_words_run_out(spark):
    text = " ".join(f"w{i}" for i in range(320))
    assert [(c["start"], len(c["words"])) for c in one(spark, text, T.chunks)] == [(0, 180), (140, 180), (280, 40)]


def test_dates_are_phones_too(spark):
    text = "Bob called Alice on 2026-05-10"
    assert one(spark, text, T.iso_dates) == ["2026-05-10"]
    assert one(spark, text, T.phones) == ["2026-05-10"]
    assert [tuple(e) for e in one(spark, text, T.events)] == [("Bob", "called", "Alice")]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.6, 0.8], [1.0, -1.0, 1.0, -1.0], [1.0, -1.0, -1.0, -1.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, d array<double>, z array<double>")
    r = row.select(V.cosine(V.normalise(F.col("a")), F.col("b")).alias("cos"), V.dot(F.col("a"), F.col("b")).alias("dot"), V.sign_bits(F.col("c"), 4).alias("c"), V.sign_bits(F.col("d"), 4).alias("d"), V.cosine(F.col("a"), F.col("z")).alias("zero"), V.dot(F.col("a"), F.col("c")).alias("uneven")).first()
    assert r["cos"] == pytest.approx(1.0) and r["dot"] == pytest.approx(5.0) and (r["zero"], r["uneven"]) == (0.0, 0.0)
    assert sum(x != y for x, y in zip(r["c"], r["d"], strict=True)) == 1


def test_append_is_not_distinct(spark):
    rows = spark.createDataFrame([("k", i, d) for i, d in enumerate("AABA")], "dedupe_key string, seq long, digest string")
    assert [r["digest"] for r in L.changed(rows).orderBy("seq").collect()] == ["A", "B", "A"]


def test_tombstones_have_no_time_and_one_family(spark):
    rows = spark.createDataFrame([("a", "1", 5), ("b", "1", 1), ("a", "2", 1)], "family string, id string, seq long")
    graves = spark.createDataFrame([("a", "1")], "family string, id string")
    assert sorted((r["family"], r["id"]) for r in L.without_tombstones(rows, graves).collect()) == [("a", "2"), ("b", "1")]


@pytest.mark.parametrize("block", [1, 2, 100])
def test_fold_skips_illegal_moves(spark, block):
    moves = [("m", i, s) for i, s in enumerate(["candidate", "pinned", "stale", "promoted", "forgotten", "pinned"])] + [("n", 0, "promoted"), ("n", 1, "candidate"), ("n", 2, "stale")]
    got = dict(G.folded_state(spark.createDataFrame(moves, "memory_id string, seq long, state string"), block).collect())
    assert got == {"m": "forgotten", "n": "stale"}


def test_null_scope_is_a_partition(spark):
    rows = spark.createDataFrame([("n", None, 1), ("n", "s", 2), ("m", None, 3)], "namespace string, scope string, id int")
    assert [r["id"] for r in rows.filter(P.in_partition("n", None)).collect()] == [1]


def test_validity(spark):
    rows = spark.createDataFrame([("2024-06-15", "2025-01-01")], "a string, b string")
    at = lambda d: rows.filter(P.valid_at(F.col("a"), F.col("b"), d)).count()
    assert (at("2024-07-01"), at("2025-06-01")) == (1, 0)


@pytest.mark.parametrize(("costs", "budget", "want"), [([(1, 0, 4), (1, 1, 109)], 8, [(1, 0)]), ([(1, 0, 110)], 4, [(1, 0)]), ([(1, 0, 3), (2, 0, 4), (3, 0, 90)], 10, [(1, 0), (2, 0)]), ([(1, 0, 3), (1, 1, 9), (1, 2, 1), (2, 0, 2)], 6, [(1, 0), (2, 0)])])
def test_budget(spark, costs, budget, want):
    got = Q.budgeted(spark.createDataFrame(costs, "grp int, pos int, cost long"), budget)
    assert sorted((r["grp"], r["pos"]) for r in got.collect()) == want


def test_fusion_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    fused = [dict(Q.fuse(ls, "id").collect()) for ls in ([a, b], [b, a])]
    assert fused[0].keys() == {"x", "y", "z"} and all(fused[0][k] == pytest.approx(fused[1][k]) for k in fused[0])


def test_components_with_cycles_and_lone_nodes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node long")
    edges = spark.createDataFrame([(0, 5, 3), (1, 3, 1), (2, 1, 5), (3, 6, 7)], "id long, source_id long, target_id long")
    assert dict(R.components(nodes, edges).collect()) == {0: 0, 1: 1, 2: 2, 3: 1, 4: 4, 5: 1, 6: 6, 7: 6}
