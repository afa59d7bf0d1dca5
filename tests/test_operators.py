"""Operators of the engine on small rows, against brute force."""

import datetime as dt
import json
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.functions import text as T
from strataq.operators import consolidation as C
from strataq.operators import embedding as E
from strataq.operators import extraction as X
from strataq.operators import forgetting as D
from strataq.operators import governance as G
from strataq.operators import intake as I
from strataq.operators import knowledge as K
from strataq.operators import log as L
from strataq.operators import recall as A
from strataq.operators import retrieval as Q
from strataq.operators import secrets as S
from strataq.operators import temporal as W


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).first()["x"]


def test_text_functions(spark):
    pairs = one(spark, '{"Name": "Ann", "more": {"AGE": 4, "deep": {"email": "a@b.c"}}}', T.flat_pairs)
    assert [tuple(p) for p in pairs] == [("name", "Ann"), ("age", "4"), ("email", "a@b.c")]
    assert one(spark, "no json", T.flat_pairs) == [] and one(spark, None, T.flat_pairs) == []
    assert [one(spark, t, T.small_talk) for t in ("Sounds good!", " ok... ", "hello?", "hello you", "")] == [True, True, True, False, False]
    assert [tuple(a) for a in one(spark, "Bob is 42. then came Eva; Eva tiene 9", T.ages)] == [("Bob", "42"), ("Eva", "9")]
    assert one(spark, "Bob is 42. Bob phone is +39 333 123 4567, room 7, on 2026-05-10", T.plain_numbers) == ["7"]
    assert one(spark, "Ann and Bob: +39 333 123 4567", lambda t: T.nearby_name(t, F.get(T.phones(t), F.lit(0)))) == "Bob"
    assert T.asks("Quando?", T.ASKS_WHEN) and not T.asks("now", T.ASKS_WHEN) and T.redacted(" ") == "secret: secret"


def test_each_text_is_read_once(spark):
    docs = spark.createDataFrame([("a b the of",), ("the the cat",), ("",), (None,)], "text string")
    rows = Q.bm25(docs, "the of cat").filter("bm25 > 0")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2  # counting words is one, too
    assert {r["text"]: r["exact"] for r in rows.collect()} == {"a b the of": 2, "the the cat": 2}
    chunk = docs.select(F.inline(T.chunks(F.col("text"))))._jdf.queryExecution().optimizedPlan().toString()
    assert chunk.count("regexp_extract_all(") == 1
    assert Q.bm25(docs, "!!").select("bm25").distinct().collect()[0][0] == 0.0


def test_fingerprints_of_cues(spark):
    for cue in ("how is Apollo going", "a b", "", "One two three four five"):
        assert Q.cue_fingerprint(cue) == one(spark, cue, T.simhash)


def test_budget_over_groups(spark):
    rng = random.Random(1)
    for budget in (0, 4, 9, 25):
        rows = [(g, p, rng.randint(1, 9)) for g in range(4) for p in range(rng.randint(0, 6))]
        want, used = [], 0
        for g in range(4):
            for p, cost in sorted((p, c) for h, p, c in rows if h == g):
                if used + cost <= budget or used == 0 and cost > budget:
                    want.append((g, p))
                    used += cost
                    if cost > budget:
                        break
                else:
                    break
        got = Q.budgeted(spark.createDataFrame(rows, "grp int, pos int, cost long"), budget)
        assert sorted((r["grp"], r["pos"]) for r in got.collect()) == sorted(want), budget


def test_numbered_over_partitions(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v long").repartition(6)
    assert [(r["v"], r["rank"]) for r in Q.numbered(rows, F.desc("v")).orderBy("rank").collect()] == [(999 - i, i + 1) for i in range(1000)]
    assert Q.numbered(rows.limit(0), F.desc("v")).count() == 0


@pytest.mark.parametrize("block", [1, 3, 100])
def test_changes_by_blocks(spark, block):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice("xyz")) for i in range(60)]
    last, want = {"a": "x"}, []
    for k, i, d in rows:
        if last.get(k) != d:
            want.append(i)
        last[k] = d
    df = spark.createDataFrame(rows, "dedupe_key string, seq long, digest string")
    before = spark.createDataFrame([("a", "x")], "dedupe_key string, digest string")
    assert sorted(r["seq"] for r in L.changed(df, before=before, block=block).collect()) == want
    facts = df.select(F.col("dedupe_key").alias("fact_key"), F.col("seq").alias("id"), F.col("digest").alias("value"))
    got = {r["id"]: (r["reason"], r["contradicts"]) for r in G.fact_events(facts, block=block).collect()}
    now = {}
    for k, i, d in rows:
        b = now.get(k)
        assert got[i] == (("fact_observed", None) if b is None else ("fact_verified", None) if b[0] == d else ("fact_replaced_previous", b[1]))
        now[k] = d, i


def test_governed_facts_by_brute_force(spark):
    rng = random.Random(3)
    events = [(f"k{rng.randint(0, 3)}", i, rng.choice(["claim"] * 3 + ["state"]), f"m{i if rng.random() < 0.8 else rng.randint(0, 40)}", rng.choice("xyz"), rng.choice(["short_term", "pinned", "contradicted", "forgotten"])) for i in range(160)]
    events = [(k, i, kind, m, v, "short_term" if kind == "claim" else s) for k, i, kind, m, v, s in events]
    want, now = [], {}
    for k, i, kind, m, v, s in events:
        cur = now.get(k)
        if kind == "state":
            if s in ("contradicted", "forgotten"):
                now[k] = None if cur and cur[0] == m else cur
            else:
                now[k] = m, v, s
        elif cur is None or cur[1] == v:
            want.append((k, i, m, v, s, "fact_verified" if cur else "fact_observed"))
            now[k] = m, v, s
        elif cur[2] == "pinned":
            want.append((k, i, m, v, "candidate", "conflicts_with_pinned_fact"))
        else:
            want += [(k, i, cur[0], cur[1], "contradicted", "replaced_by_newer_fact"), (k, i, m, v, "promoted", "fact_replaced_previous")]
            now[k] = m, v, "promoted"
    df = spark.createDataFrame(events, "fact_key string, seq long, kind string, memory_id string, value string, state string").repartition(5)
    assert sorted(tuple(r) for r in G.governed_facts(df).collect()) == sorted(want)
    assert any(w[5] == "conflicts_with_pinned_fact" for w in want)


def test_related_pairs_by_brute_force(spark):
    rng = random.Random(4)
    chunks = [(i, sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))})) for i in range(20)]
    df = spark.createDataFrame([(chunks,)], "c array<struct<id: long, terms: array<string>>>")
    want = []
    for i, a in chunks:
        for j, b in chunks[i + 1 :]:
            w = round(len(set(a) & set(b)) / max(1, len(set(a) | set(b))), 6)
            if w >= 0.18 and set(a) & set(b):
                want.append((-w, i, j))
    for most in (7, 400):
        got = df.select(F.inline(I.related(F.col("c"), most=most))).collect()
        assert [(-r["weight"], r["a"], r["b"]) for r in got] == sorted(want)[:most]


def test_same_entity_and_context(spark):
    nodes = spark.createDataFrame([(c, i) for i, c in enumerate("abacab")], "canonical string, id long")
    assert sorted((r["source_id"], r["target_id"]) for r in I.same_entity(nodes).collect()) == [(0, 2), (0, 4), (1, 5)]
    rows = spark.createDataFrame([(f"m{i}", i, "ab"[i % 2], "t" if i % 3 == 0 else None) for i in range(30)], "id string, seq long, stream string, task_id string")
    got = {r["seq"]: r["recent"] for r in I.recent_context(rows, most=4).collect()}
    for i in range(30):
        near = [j for j in range(i) if j % 2 == i % 2 or i % 3 == 0 and j % 3 == 0]
        by = sorted(set([j for j in range(i) if j % 2 == i % 2][-4:] + ([j for j in range(i) if j % 3 == 0][-4:] if i % 3 == 0 else [])), reverse=True)[:4]
        assert got[i] == [f"m{j}" for j in by] and by == sorted(near, reverse=True)[:4]


def test_adapter_fragments(spark):
    rows = X.extracted(spark.createDataFrame([("1", "Ann met Bob"), ("2", None)], "id string, text string"))
    node = lambda i: (i, "memory_entity", "Entity: Zed", "zed", None, None, None, None, False, 0.9)
    made = spark.createDataFrame([("1", [node("entity:z"), node("entity:z")], [("entity:z", "likes", "entity:z", None), ("entity:z", "actor", "nobody", 1.0)])], f"id string, nodes {X.NODE}, links {X.EDGE}")
    out = {r["id"]: r for r in X.with_adapter(rows, lambda _: made).collect()}
    assert sum(n["local_id"] == "entity:z" for n in out["1"]["nodes"]) == 1 and out["2"]["nodes"] == []
    assert [(x["relation"], x["weight"]) for x in out["1"]["links"] if x["source"] == "entity:z"] == [("related_to", 1.0)]
    assert X.with_adapter(rows, lambda _: 1 / 0).count() == 2
    with pytest.raises(ValueError):
        X.extracted(rows.select("id", "text"), mode="loud")
    raw = X.extracted(spark.createDataFrame([("1", "Ann: +39 333 123 4567", '{"name": "Ann", "phone": "555 123 4567", "age": 5}')], "id string, text string, j string"), structured="j", mode="raw").first()
    assert {(n["value_kind"], n["value"]) for n in raw["nodes"] if n["kind"] == "memory_value"} >= {("phone", "+39 333 123 4567"), ("phone", "555 123 4567"), ("age", "5")}


# Times.


def test_times(spark):
    texts = ["2026-05-10T10:00:00Z", "2026-05-10T12:00:00+02:00", "2026-05-10T10:00:00", "2026-05-10", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_seconds(W.normal(F.col("t")))).collect()]
    at = int(dt.datetime(2026, 5, 10, 10, tzinfo=dt.UTC).timestamp())
    assert got == [at, at, None, None, None, None]
    day = dt.datetime(2026, 5, 10, tzinfo=dt.UTC)
    assert [W.moment_of(x) for x in (dt.date(2026, 5, 10), dt.datetime(2026, 5, 10), "2026-05-10T00:00:00Z", "2026-05-10T00:00:00", "x", 5, None)] == [day, day, day, None, None, None, None]
    assert W.defaults({"valid_from": "2026-05-10T00:00:00Z"}, day) == {"occurred_at": None, "observed_at": day.isoformat(), "last_verified_at": None, "valid_from": day.isoformat(), "valid_until": None}
    payload = json.dumps({"metadata": {"valid_from": "2026-01-01T00:00:00Z", "provenance": {"observed_at": "2026-01-02T00:00:00Z", "valid_from": "2020-01-01T00:00:00Z"}}})
    row = spark.createDataFrame([(payload,)], "p string").select(*[c.cast("date").cast("string").alias(f) for f, c in W.found_in(F.col("p")).items()]).first()
    assert (row["valid_from"], row["observed_at"], row["occurred_at"]) == ("2026-01-01", "2026-01-02", None)
    assert W.cutoff(day, 1000) == day - dt.timedelta(seconds=1)
    with pytest.raises(ValueError):
        W.cutoff(day, True)


# Recall and what follows.


def test_structured_scores(spark):
    rows = [("memory_entity", "Entity: Bob", "bob"), ("memory_event", "Event: Bob called", None), ("memory_time", "Time: x", None), ("memory_value", "Value: 5", None), ("text", "Bob", None)]
    df = spark.createDataFrame([(*r, 1.5, 0.0) for r in rows], "kind string, text string, canonical string, attention double, score double")
    score = lambda cue: [r["score"] for r in A.reranked(df, cue).collect()]
    assert score("When did Bob call? bob called") == [8.5, 6.5, 4.5, 0.0, 0.0]
    assert score("phone of bob") == [8.5, 0.0, 0.0, 4.5, 0.0]
    named = df.select(A.structured_score("ask Robert", F.col("kind"), F.col("text"), F.col("attention"), F.col("canonical"), F.array(F.lit("Robert"))).alias("s"))
    assert named.first()["s"] == 7.5
    assert A.budget("high") == (4, 3)


def test_merging_and_evidence(spark):
    schema = "source string, family string, id string, score double, text string"
    a = spark.createDataFrame([("x", "m", "1", 2.0, "t"), ("x", "m", "2", 5.0, "t")], schema)
    b = spark.createDataFrame([("x", "m", "1", 3.0, "u"), ("y", "m", "1", 3.0, "u")], schema)
    assert [(r["source"], r["id"], r["score"], r["rank"]) for r in A.merged([a, b], 3).collect()] == [("x", "2", 5.0, 1), ("x", "1", 3.0, 2), ("y", "1", 3.0, 3)]
    lists = [spark.createDataFrame([("1", 5), ("2", 1)], "id string, rank long"), spark.createDataFrame([("1", 1), ("3", 2)], "id string, rank long")]
    assert sorted((r["id"], r["rank"]) for r in A.first_of(lists, ["id"]).collect()) == [("1", 5), ("2", 1), ("3", 2)]
    models = spark.createDataFrame([("mm", "ans", 1)], "id string, answer string, rank long")
    obs = spark.createDataFrame([("o1", "s1", "fact", 1), ("o2", "s2", "decision", 2)], "id string, statement string, type string, rank long")
    mem = spark.createDataFrame([("m", "txt", 1)], "id string, text string, rank long")
    assert [r["id"] for r in A.evidence(models, obs, mem).orderBy("place").collect()] == ["mm", "o2", "o1", "m"]


def test_references_and_targets(spark):
    payload = json.dumps({"id": "a", "source_id": "b", "source_ids": ["c"], "metadata": {"provenance": {"source_ids": ["d"]}}, "other": "e"})
    assert sorted(one(spark, payload, D.references)) == ["a", "b", "c", "d"]
    assert one(spark, "{}", D.references) == []


def test_windows(spark):
    rows = [("a", 1, 1, "s", "t1", "alpha beta"), ("b", 1, 2, "r", None, "gamma"), ("c", 3, 9, "s", "t2", "delta")]
    labelled = spark.createDataFrame(rows, "node string, component long, seq long, stream string, task_id string, text string")
    edges = spark.createDataFrame([("e", "a", "b")], "id string, source_id string, target_id string")
    got = {r["component"]: r for r in C.windows(labelled, edges).collect()}
    assert (got[3]["window"], got[1]["window"], got[1]["stream"], got[1]["edges"], got[3]["edges"]) == ("window_1", "window_2", "mixed", 1, 0)
    assert got[1]["keywords"] == ["alpha", "beta", "gamma"] and got[1]["task_ids"] == ["t1"]


def test_compaction_of_nothing(spark):
    moments = spark.createDataFrame([], "id string, kind string, text string, attention double, seq long")
    events = spark.createDataFrame([], "type string, name string, summary string, text string, source_id string, seq long")
    rows = C.compacted_knowledge(moments, events).collect()
    assert [(r["type"], r["summary"]) for r in rows] == [("summary", "No compact knowledge has been built yet.")]
    records = spark.createDataFrame([("moments", str(i), i, json.dumps({"attention": i})) for i in range(9)], "family string, id string, seq long, payload string")
    assert C.semantic(records, ["moments"], 3).first()["source_ids"] == ["6", "7", "8"]
    assert C.semantic(records, ["moments"], 3, lambda df: df.select("id")).count() == 3
    out = K.normalised(spark.createDataFrame([(None, " x ", None)], "type string, summary string, text string")).first()
    assert (out["type"], out["text"]) == ("fact", "x")
    model = K.mental_models(spark.createDataFrame([("first line\nsecond",)], "text string"), "n").first()
    assert (model["title"], model["query"], model["answer"]) == ("first line", "first line", "first line\nsecond")


# Secrets and vectors.


def test_secrets_are_bound_to_their_place(spark):
    rows = spark.createDataFrame([("n", None, "1", None, "word"), ("n", "s", "2", " pin ", "1234")], "namespace string, scope string, id string, label string, text string")
    key = bytes(range(32))
    hidden = S.sealed(rows, key)
    assert [r["text"] for r in hidden.orderBy("id").collect()] == ["secret: secret", "secret: pin"]
    yes = lambda r: F.lit(True)
    assert [(r["text"], r["locked"]) for r in S.revealed(hidden, key, yes).orderBy("id").collect()] == [("word", False), ("1234", False)]
    assert all(r["locked"] for r in S.revealed(hidden, key).collect())
    for moved in (hidden.withColumn("id", F.lit("9")), hidden.withColumn("namespace", F.lit("m")), hidden.withColumn("label", F.lit("z"))):
        assert all(r["locked"] for r in S.revealed(moved, key, yes).collect())
    with pytest.raises(ValueError):
        S.sealed(rows, b"short")


def write_model(folder, vocab, matrix):
    folder.mkdir()
    (folder / "tokenizer.json").write_text(json.dumps({"model": {"vocab": vocab}}))
    data = matrix.astype("<f4").tobytes()
    header = json.dumps({"__metadata__": {}, "embeddings": {"dtype": "F32", "shape": list(matrix.shape), "data_offsets": [0, len(data)]}}).encode()
    (folder / "model.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + data)


def test_static_model(spark, tmp_path):
    matrix = np.array([[1, 0], [0, 1], [3, 4]])
    write_model(tmp_path / "m", {"apple": 0, "▁pear": 1, "Plum": 2, "lost": 9}, matrix)
    model = E.StaticModel.load(str(tmp_path / "m"))
    docs = spark.createDataFrame([(1, "Apple apple pear"), (2, "plum!"), (3, "lost words"), (4, None)], "id long, text string")
    got = {r["id"]: r["vector"] for r in E.mean_pooled(docs, model.rows(spark), "id", model_rows=3).collect()}
    assert got[1] == pytest.approx([2**-0.5] * 2) and got[2] == pytest.approx([0.6, 0.8]) and set(got) == {1, 2}
    with pytest.raises(ValueError, match="SHA"):
        E.StaticModel.load(str(tmp_path / "m"), {"model.safetensors": "0" * 64})
    for broken in (b"", b"123", struct.pack("<Q", 2) + b"{}", struct.pack("<Q", 90) + b"x"):
        with pytest.raises(ValueError):
            E.read_matrix(broken)


def test_adapters_that_fail_leave_no_vector(spark):
    docs = spark.createDataFrame([(1, "apple"), (2, None)], "id long, text string")
    assert [r["vector"] for r in E.embedded(docs, lambda ts: [[1.0, 0.0] if "apple" in t else None for t in ts]).orderBy("id").collect()] == [[1.0, 0.0], None]
    assert {r["vector"] for r in E.embedded(docs, lambda ts: 1 / 0).collect()} == {None}
    assert {r["vector"] for r in E.embedded(docs.coalesce(1), lambda ts: [[1.0]] * 9).collect()} == {None}


def test_index_writes_and_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64))
    x = centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 64))
    rows = spark.createDataFrame([(f"{i:04d}", "a" if i % 9 == 0 else None, v.tolist()) for i, v in enumerate(x)], "id string, scope string, vector array<double>")
    index = E.VectorIndex.empty(spark).upsert(rows)
    hits = total = 0
    for i in range(0, 900, 225):
        for scope in (None, "a"):
            want = {r["id"] for r in index.exact(x[i].tolist(), 10, scope).collect()}
            got = {r["id"] for r in index.near(x[i].tolist(), 10, scope).collect()}
            hits, total = hits + len(want & got), total + len(want)
    assert hits >= 0.9 * total and total == 80
    index = index.delete(rows.filter("id < '0100'").select("id")).upsert(rows.filter("id = '0005'"))
    assert index.rows.count() == 801 and index.reset().rows.count() == 0


# Sources and contexts.


def test_frames(spark, tmp_path):
    from strataq.sources import frames as R

    whole = [R.encode(i, 1000 + i, {"family": "moments", "id": i, "payload": {"n": i}}) for i in range(4)]
    torn = {"torn": whole[3][:-3], "magic": b"XXXX" + whole[3][4:], "bits": whole[3][:-1] + b"!", "none": b"", "short": b"SQ"}
    for name, tail in torn.items():
        assert [seq for seq, _, _ in R.decode(b"".join(whole[:3]) + tail + whole[0])][:3] == [0, 1, 2]
        (tmp_path / f"{name}.log").write_bytes(b"".join(whole[:3]) + tail)
    rows = R.read_frames(spark, str(tmp_path))
    assert rows.count() == 15 and R.last_seq(rows) == 2 and R.last_seq(rows.limit(0)) == -1
    assert rows.filter("seq = 2").select("payload").distinct().first()[0] == '{"n": 2}'
    again = R.framed(rows.filter("path LIKE '%torn.log'").repartition(1)).collect()
    assert [r for c in again for r in R.decode(bytes(c["content"]))] == [(i, 1000 + i, {"family": "moments", "id": str(i), "payload": {"n": i}}) for i in range(3)]
    with pytest.raises(ValueError):
        R.encode(0, 0, {"x": "y" * (R.MOST + 1)})
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text('{"family": "f", "id": 1, "payload": {}}\n{"family": "f", "id": 2}\n{torn\n{"family": "f", "id": 3}\n')
    assert [r["id"] for r in R.read_json_lines(spark, str(tmp_path / "lines")).orderBy("place").collect()] == ["1", "2"]


def test_frames_leave_in_files_of_bounded_size(spark):
    """A partition's frames were once joined into one file, and a file's rows into one batch (frame_roundtrip)."""
    import json

    import pyarrow as pa

    from strataq.sources import frames as R

    def rows(n):
        return spark.range(n, numPartitions=1).selectExpr("id AS seq", "id + 5 AS at_ms", "'moments' AS family", "CAST(id AS STRING) AS id", """IF(id = 50, concat('"', array_join(transform(sequence(1, 900), x -> md5(CAST(x AS STRING))), ''), '"'), concat('{"k": ', id, '}')) AS payload""")

    files = R.framed(rows(200), most=1000).orderBy("part", "place").collect()
    sizes = [len(f["content"]) for f in files]
    assert len(files) > 10 and [f["place"] for f in files] == list(range(len(files)))
    assert [n > 1000 for n in sizes].count(True) == 1  # the file of the one record that is larger
    back = [r for f in files for r in R.decode(bytes(f["content"]) + b"SQFR torn")]
    assert [(seq, ms, r["id"]) for seq, ms, r in back] == [(i, i + 5, str(i)) for i in range(200)]
    assert [r["payload"] for _, _, r in back if r["id"] != "50"] == [{"k": i} for i in range(200) if i != 50] and len(back[50][2]["payload"]) == 28800
    assert R.framed(rows(0)).count() == 0
    most = R.framed(rows(30_000)).selectExpr("max(length(content))", "count(*)").first()
    assert R.FILE / 2 < most[0] <= R.FILE and most[1] > 1
    data = b"".join(R.encode(i, 0, {"family": "f", "id": i, "payload": {"n": i}}) for i in range(25_000))
    out = list(R.unframed(iter([pa.record_batch([pa.array(["a", "b"]), pa.array([data, data + b"SQ"], pa.binary())], ["path", "content"])])))
    assert max(b.num_rows for b in out) <= R.ROWS
    assert [(r["path"], r["seq"], json.loads(r["payload"])["n"]) for b in out for r in b.to_pylist()] == [(p, i, i) for p in "ab" for i in range(25_000)]


def test_frames_reach_python_in_small_batches(spark):
    from strataq.sources import frames as R

    files = spark.range(40, numPartitions=1).selectExpr("CAST(repeat('x', 1 << 20) AS BINARY) AS content")
    assert R.frames_of(files).count() == 0
    sizes = files.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 40 and max(r["n"] for r in sizes) <= 10


@pytest.mark.parametrize("n", [0, 1, 100, 511, 512, 40_000, 1 << 20])
def test_short_windows_are_plain_zlib(n):
    import zlib

    from strataq.sources import frames as R

    plain = bytes(i * i % 251 for i in range(n))
    assert zlib.decompress(R.deflated(plain)) == plain


def test_contexts_and_small_helpers():
    from strataq.context import QueryContext, scope_of, until_error
    from strataq.functions import vectors as V

    c = QueryContext("When did Bob call?", "n", "s")
    assert c.keywords == ("when", "did", "bob", "call") and c.entities == ("When", "Bob") and c.ensure("n", "s") is c
    for other in (("n", None), ("m", "s")):
        with pytest.raises(ValueError):
            c.ensure(*other)
    assert scope_of() is None and scope_of(a=None) is None and scope_of(a=1, b=2) == scope_of(b=2, a=1) != scope_of(a=1)
    assert until_error([lambda: 1, lambda: 2])[1] is None and until_error([lambda: 1, lambda: 1 / 0, lambda: 3])[0] == [1]
    assert V.from_binary(V.to_binary([1.0, -2.5])) == [1.0, -2.5] and V.from_binary(b"123") is None and V.from_binary(None) is None


def brute_links(anchors, others, gone, least, most):
    """The strongest of all pairs, by sets."""
    out = {}
    jaccard = lambda x, y: len(set(x) & set(y)) / max(1, len(x) + len(y) - len(set(x) & set(y)))
    for i, root, task, *a in anchors:
        for j, other, task_, *b in others:
            if None in (root, other) or root == other or None in a or None in b or not any(set(x) & set(y) for x, y in zip(a, b, strict=True)):
                continue
            k, e, c = (jaccard(x, y) for x, y in zip(a, b, strict=True))
            weight = round(min(1.0, max(k, e) + 0.25 * c + (0.12 if task is not None and task == task_ else 0.0)), 6)
            if weight >= least and (i, j) not in gone and (j, i) not in gone:
                out.setdefault(root, []).append((-weight, i, j))
    return sorted((root, i, j, -w) for root, rows in out.items() for w, i, j in sorted(rows)[:most])


def test_cross_links_by_brute_force(spark):
    rng = random.Random(3)
    words = [*(f"w{i}" for i in range(30)), "a\nb", "a", "b", "a\\nb", ""]

    def row(i, root):
        some = lambda n: rng.sample(words, rng.randint(0, n))
        return (f"m{i}", root, rng.choice([None, "t1", "t2"]), some(9), some(3), [rng.choice(["user", "other"])])

    others = [row(i, f"r{i % 40}") for i in range(400)]
    others += [("n1", None, "t1", ["w1"], [], ["user"]), ("n2", "r1", "t1", None, [], ["user"]), ("n3", "r1", "t1", [], [], ["user"])]
    anchors = [*others[:60], ("m900", "r900", "t1", [], [], []), ("m901", "r901", None, ["nobody"], [], ["user"])]
    fields = "id string, root_id string, task_id string, keywords array<string>, entities array<string>, categories array<string>"
    a, o = spark.createDataFrame(anchors, fields), spark.createDataFrame(others, fields)
    gone = {(x[0], y[0]) for x in anchors[:20] for y in others[::7]}
    linked = spark.createDataFrame([(x, y) if rng.random() < 0.5 else (y, x) for x, y in sorted(gone)], "source_id string, target_id string")
    for least, most, held in ((0.24, 20, None), (0.24, 3, linked), (0.05, 500, None)):
        got = I.cross_links(a, o, held, least, most)
        want = brute_links(anchors, others, gone if held is not None else set(), least, most)
        assert sorted((r.root_id, r.source_id, r.target_id, r.weight) for r in got.collect()) == want


def test_cross_links_list_no_pairs(spark):
    """With one category everywhere each pair has a term in common; only each anchor's strongest rows leave a block."""
    rows = spark.range(4000).select(F.col("id"), F.col("id").alias("root_id"), F.lit("t").alias("task_id"), F.array().cast("array<string>").alias("keywords"), F.array().cast("array<string>").alias("entities"), F.array(F.lit("user")).alias("categories"))
    out = I.cross_links(rows, rows)
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # a join on terms would make 16 million pairs here
    assert out.count() == 80_000 and out.filter("target_id > 20").count() == 0


def test_pooled_means_send_no_texts_to_the_driver(spark, tmp_path):
    """Texts from a small file, whose exploded words Spark takes for small too."""
    rows = [(i % 900, f"Word{i} word{i % 7} ſa sa {i % 5}-{i}") for i in range(1000)] + [(5000, None), (5001, ""), (5002, "unknown"), (None, "1 2")]
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    made = [(str(i), [float(i), 1.0, -0.5 * i]) for i in range(600)] + [("Sa", [0.0, 3.0, 1.0]), ("▁word3", [2.0, 2.0, 0.5]), ("3", [9.0, None, 1.0]), ("4", [7.0]), ("1", None)]
    spark.createDataFrame(made, "token string, vector array<double>").write.parquet(str(tmp_path / "model"))
    docs, model = spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "model"))
    out = E.mean_pooled(docs, model, "id")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    vectors, want = {}, {}
    for t, v in made:
        vectors.setdefault(t, []).append(v)
    for i, text in rows:
        words = {w for w in re.split(r"[^\w]+", (text or "").lower()) if w}
        forms = {f for w in words for f in (w, " " + w, "Ġ" + w, "▁" + w, w[:1].upper() + w[1:])}
        want.setdefault(i, []).extend(v for f in sorted(forms) for v in vectors.get(f, []) if v is not None)
    want = {i: v for i, v in want.items() if v}
    got = {r["id"]: r["vector"] for r in out.collect()}
    assert set(got) == set(want) and out.count() == len(want)
    for i, held in want.items():
        dims = max(map(len, held))
        parts = [[v[d] for v in held if d < len(v) and v[d] is not None] for d in range(dims)]
        mean = np.array([np.mean(p) for p in parts])
        size = np.sqrt((mean * mean).sum())
        assert np.allclose(got[i][:dims], mean / size if size else mean), i
