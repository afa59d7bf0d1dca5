"""The engine end to end, its sources and its streams."""

import json

import pytest
from pyspark.sql import functions as F

from strataq.engine import Memory
from strataq.sources.lines import read_lines
from strataq.sources.log_store import LogStore, Placeholder, Route, StoreConfig, compact, decoded, encoded, enveloped, family, supports, write_all
from strataq.sources.records import RecordSource
from strataq.streaming import ingest as S


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, str(tmp_path / "log"), "main")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_states_rank_and_hide(memory):
    found = [memory.signal(f"The Apollo deploy checklist number {i}", task_id="t") for i in range(3)]
    for i, s in zip(found, ("pinned", "stale", "contradicted"), strict=True):
        assert memory.set_state(i, s)
    assert not memory.set_state(found[2], "pinned")
    assert ids(memory.search("apollo deploy checklist").filter("source = 'durable'")) == [found[0], found[1]]
    assert set(ids(memory.search("apollo deploy checklist").filter("source = 'active'"))) == {found[0], found[1]}


def test_recall_follows_edges_and_budget(memory):
    a, b, c = memory.signal("Orbit plan for Apollo"), memory.signal("unrelated words here"), memory.signal("nothing at all")
    memory.link(a, "related_to", b)
    assert ids(memory.recall("Apollo orbit")) == [a, b]
    assert ids(memory.recall("Apollo orbit", max_tokens=5)) == [a]
    assert ids(memory.recall("Apollo orbit", max_tokens=500)) == [a, b]
    assert memory.recall("!!! ???").count() == 0 and memory.recall("").count() == 0
    with pytest.raises(KeyError):
        memory.link(a, "related_to", "nobody")
    art = memory.artifact("plan.txt", memory_id=b)
    recipe = memory.recipe(b, "fly")
    assert memory.run_recipe(recipe)["status"] == "inert" and memory.run_recipe(recipe, lambda r: r["text"])["result"] == "fly"
    again = memory.context("Apollo orbit")
    assert ids(memory.recall(again)) == [a, b]
    with pytest.raises(ValueError):
        Memory(memory.spark, memory.path, "other").recall(again)
    near = memory.around(memory.recall("Apollo orbit", limit=1).select("id"))
    assert near["artifacts"].count() == 0 and ids(near["recipes"]) == [recipe]
    assert ids(memory.around(memory.moments().select("id"))["artifacts"]) == [art]
    with pytest.raises(ValueError):
        memory.recall("x", limit=-1)
    with pytest.raises(ValueError):
        memory.recall("x", budget="huge")


def test_windows_and_promotion_once(memory):
    a, b, c = memory.signal("left"), memory.signal("right"), memory.signal("solo")
    memory.link(a, "related_to", b)
    assert {r["id"]: r["window"] for r in memory.consolidate().collect()} == {c: 1, a: 2, b: 2}
    assert memory.consolidate().count() == 0
    assert {r["state"] for r in memory.moments().collect()} == {"promoted"}
    assert memory.records("knowledge", "source_id string").count() == 3
    job = memory.records("consolidation_jobs", "knowledge long, windows long, associations long").collect()
    assert [(j["knowledge"], j["windows"], j["associations"]) for j in job] == [(3, 2, 1)]


def test_weak_neighbours_are_consolidated_too(memory):
    a, b, c = memory.signal("strong", attention=2.0), memory.signal("weak", attention=0.2), memory.signal("alone", attention=0.2)
    memory.link(a, "related_to", b)
    assert set(ids(memory.consolidate(least=2.0))) == {a, b}


def test_forget_takes_all_that_refers_along(memory):
    a, b = memory.signal("first"), memory.signal("second")
    memory.link(a, "related_to", b)
    recipe = memory.recipe(a, "run it")
    memory.put_mental_model("t", "q", "answer", source_ids=[a])
    assert memory.forget(F.col("text") == "first") == 1
    assert ids(memory.moments()) == [b] and memory.edges().count() == 0
    assert memory.records("action_recipes", "text string").count() == 0 and recipe
    assert memory.mental_models().count() == 0 and memory.records("signals", "input string").count() == 1
    assert memory.states().filter(F.col("memory_id") == a).first()["state"] == "forgotten"
    memory.log.compact()
    assert ids(memory.moments()) == [b] and memory.forget(("stream", "chat")) == 1 and memory.moments().count() == 0
    with pytest.raises(ValueError):
        memory.forget(5)


def test_newer_facts_replace_and_pinned_ones_hold(memory):
    old = memory.signal("Alice email is old@example.com")
    new = memory.signal("Alice email is new@example.com")
    states = {r["memory_id"]: r["state"] for r in memory.states().collect()}
    assert states == {old: "contradicted", new: "promoted"}
    assert ids(memory.search("alice email").filter("source = 'durable'")) == [new]
    memory.set_state(new, "pinned")
    late = memory.signal("Alice email is late@example.com")
    states = {r["memory_id"]: r["state"] for r in memory.states().collect()}
    assert states == {old: "contradicted", new: "pinned", late: "candidate"}


def test_decay_and_maintenance(memory):
    import datetime as dt

    fact = memory.signal("Bob status is busy")
    memory.signal("no fact")
    assert memory.decay(0, dt.datetime.now(dt.UTC) + dt.timedelta(seconds=5)) == 1
    assert memory.decay(0, dt.datetime.now(dt.UTC) + dt.timedelta(seconds=5)) == 0
    assert {r["memory_id"]: r["state"] for r in memory.states().collect()}[fact] == "stale"
    done = memory.maintain()
    assert done["consolidated"] == 2 and done["compacted"] is not None
    with pytest.raises(ValueError):
        memory.decay(-1)


def test_what_was_valid_then(memory):
    memory.signal("The Orion lease", valid_from="2024-06-15T00:00:00Z", valid_until="2025-01-01T00:00:00Z", occurred_at="2024-06-15T00:00:00Z")
    for filters, n in (({"valid_at": "2024-07-01T00:00:00Z"}, 1), ({"valid_at": "2025-06-01T00:00:00Z"}, 0), ({"valid_at": "no time"}, 1), ({"occurred_after": "2024-06-15T00:00:00+00:00"}, 1), ({"occurred_before": "2024-06-01T00:00:00Z"}, 0)):
        assert memory.recall("Orion lease", **filters).count() == n, filters


def test_intake_graph(memory, spark):
    text = " ".join(["We must fix the deadline task because an exception error happened again and again in the old module here"] * 12)
    docs = spark.createDataFrame([("d1", text), ("d2", "  "), ("d3", "Bob called Alice on 2026-05-10"), ("d4", "Bob is 42. Bob phone is +39 333 123 4567.")], "id string, text string")
    from strataq.operators import intake as I

    rows = I.packets(docs, size=24, overlap=6)
    made = {r["id"]: r for r in I.memories(rows).collect()}
    kinds = [r["kind"] for k, r in made.items() if k.startswith("d1")]
    assert made["d1"]["kind"] == "task" and kinds.count("memory_chunk") > 3 and kinds.count("memory_summary") == kinds.count("memory_chunk") + 1
    assert {"d1/category/task", "d1/category/error"} <= set(made)
    links = {(r["source_id"], r["relation"], r["target_id"]) for r in I.links(rows).collect()}
    assert {"contains_chunk", "next_chunk", "previous_chunk", "has_summary", "categorized_as", "related_chunk", "summarizes", "has_category"} <= {x[1] for x in links if x[0].startswith("d1")}
    names = {r["canonical"]: k for k, r in made.items() if r["canonical"] and k.startswith("d3")}
    assert set(names) == {"bob", "alice"}
    event = next(k for k, r in made.items() if r["kind"] == "memory_event")
    day = next(k for k, r in made.items() if r["kind"] == "memory_time" and k.startswith("d3"))
    assert made[day]["text"] == "Time: 2026-05-10"
    assert {("d3", "mentions_entity", names["bob"]), (event, "actor", names["bob"]), (event, "acted_on", names["alice"]), (event, "happened_at", day), (event, "observed_in", "d3")} <= links
    values = {r["value_kind"]: r for k, r in made.items() if r["kind"] == "memory_value" and k.startswith("d4")}
    assert (values["age"]["value"], values["phone"]["value"], values["phone"]["display"]) == ("42", None, "[redacted phone]") and "number" not in values
    bob = next(k for k, r in made.items() if r["canonical"] == "bob" and k.startswith("d4"))
    assert {(bob, "has_value", values["age"]["id"]), (bob, "has_value", values["phone"]["id"])} <= links


def test_remember_links_to_older_memories(memory, spark):
    make = lambda *rows: spark.createDataFrame(rows, "id string, text string")
    memory.remember(make(("a", "Carla approved the Orion budget review for spring")))
    kinds = {r["kind"] for r in memory.remember(make(("b", "Carla approved the Orion budget review for autumn"))).collect()}
    assert {"memory_chunk", "memory_summary", "memory_entity", "memory_category"} <= kinds
    e = {(r["source_id"], r["relation"], r["target_id"]) for r in memory.edges().collect()}
    assert ("b", "related_memory", "a") in e and any(s.startswith("b/entity") and r == "same_entity" and t.startswith("a/entity") for s, r, t in e)
    n = memory.moments().count()
    memory.remember(make(("b", "Carla approved the Orion budget review for autumn")))
    assert memory.moments().count() == n
    assert memory.remember(make(("c", "x")), plugs=[lambda df: None]).count() == 0
    assert memory.remember(make(("c", "Thanks!"), ("d", "We decided to use the schema")), mission="code_agent", extract=False).select("id").filter("id = 'c'").count() == 0
    assert memory.moments().filter("id = 'd'").first()["attention"] == 1.8
    with pytest.raises(ValueError):
        memory.remember(make(("e", "x")), plugs=[lambda df: df.select("id")])


def test_secrets(spark, tmp_path):
    allow = {"yes": False}
    m = Memory(spark, str(tmp_path / "log"), "main", key=b"k" * 32, may_reveal=lambda rows: F.lit(allow["yes"]))
    m.remember(spark.createDataFrame([("s1", "hunter2", True, "door"), ("p1", "plain words", False, None)], "id string, text string, secret boolean, label string"))
    assert "hunter2" not in json.dumps([r["payload"] for r in m.log.scan().collect()])
    assert m.search("door").filter("id = 's1'").first()["text"] == "secret: door"
    assert m.reveal("s1").first()["locked"]
    allow["yes"] = True
    row = m.reveal("s1").first()
    assert (row["text"], row["locked"]) == ("hunter2", False)
    other = Memory(spark, str(tmp_path / "log"), "main", key=b"x" * 32, may_reveal=lambda rows: F.lit(True))
    assert other.reveal("s1").first()["locked"]
    with pytest.raises(ValueError):
        Memory(spark, str(tmp_path / "log"), "main").reveal("s1")


def test_observe_learn_reflect(memory):
    memory.signal("We decided to ship it on Friday")
    memory.signal("We decided to ship it on Friday")
    made = memory.consolidate_observations()
    row = made.filter("type = 'decision'").first()
    assert row["proof_count"] == 2 and row["state"] == "promoted"
    got = memory.verify_observation(row["id"], "contradicts").first()
    assert got["contradiction_count"] == 1 and got["confidence"] == pytest.approx(row["confidence"] - 0.16)
    assert memory.search_observations("decided ship").first()["confidence"] == pytest.approx(got["confidence"])
    with pytest.raises(KeyError):
        memory.verify_observation("nobody", "supports")
    assert memory.learn("- Restart. Slowly\n1. stop\n2) start")["steps"][1:] == ["stop", "start"]
    memory.put_mental_model("shipping", "how to ship", "slowly")
    memory.put_mental_model("shipping", "how to ship", "fast")
    evidence, sure = memory.reflect("ship friday")
    rows = evidence.orderBy("place").collect()
    assert sure == 0.9 and [r["type"] for r in rows][:2] == ["mental_model", "observation"] and rows[-1]["type"] == "moment" and rows[0]["claim"] == "fast"
    assert memory.search_knowledge("restart").first()["type"] == "skill"
    assert memory.load_knowledge().count() == 1
    assert "decided" in memory.compact_knowledge()
    kinds = [r["type"] for r in memory.knowledge().collect()]
    assert kinds.count("skill") == 1 and kinds.count("compaction_marker") == 1 and "latest_ingestion" in kinds
    assert memory.semantic_compaction().filter("family = 'moments'").first()["count"] == 2
    assert memory.status().filter("by = 'stream'").first()["name"] == "chat"


def test_evaluation(memory, spark):
    memory.remember(spark.createDataFrame([("f", "EvalSubject3 email is eval3@example.com"), ("r", "research EvalSubject1 durable hybrid recall checkpoint 1")], "id string, text string"), extract=False)
    cases = spark.createDataFrame([("EvalSubject3 email", "eval3@example.com", "fact"), ("EvalSubject1 hybrid recall", "checkpoint 1", "research"), ("nothing", "nowhere", "research")], "cue string, token string, label string")
    assert {r["label"]: r["hit_rate"] for r in memory.evaluate(cases).collect()} == {"fact": 1.0, "research": 0.5}


def test_other_scopes_stay_apart(spark, tmp_path):
    a, b = (Memory(spark, str(tmp_path / "log"), "main", s) for s in (None, ""))
    c = Memory(spark, str(tmp_path / "log"), "other")
    a.signal("alpha")
    b.signal("beta")
    c.signal("gamma")
    texts = lambda m: [r["text"] for r in m.moments().collect()]
    assert texts(a) == ["alpha"] and texts(b) == ["beta"]
    a.forget(F.lit(True))
    assert texts(a) == [] and texts(b) == ["beta"] and texts(c) == ["gamma"]
    rows = {r["scope"] for r in a.log.replay("main", all_scopes=True).collect()}
    assert rows == {None, ""}


# The log.


def rows_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, payload string")


def test_a_log_opened_again_goes_on(spark, tmp_path):
    open_ = lambda: LogStore(spark, str(tmp_path / "s"))
    put = lambda payload, id_="1": open_().append(enveloped(rows_of(spark, (id_, payload)), "n", None, "moments"))
    assert open_().replay("n").count() == 0 and open_().compact() is None
    assert [put("a"), put("b")] == [0, 1]
    seqs = [r["seq"] for r in open_().scan().collect()]
    assert len(set(seqs)) == 2
    assert open_().compact() == 1 and open_().compact() == 1
    assert put("c", "2") == 2
    assert {r["id"]: r["payload"] for r in open_().replay("n").collect()} == {"1": "b", "2": "c"}
    assert open_().compact() == 2
    put("d")
    assert {r["id"]: r["payload"] for r in open_().replay("n").collect()} == {"1": "d", "2": "c"}
    assert open_().get("moments", "1", "n").first()["payload"] == "d" and open_().get("moments", "1", "m").count() == 0


def test_equal_rows_are_written_once(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    for p in "aaba":
        store.append(enveloped(rows_of(spark, ("1", p)), "n", None, "moments"))
    assert [r["payload"] for r in store.scan().orderBy("seq").collect()] == ["a", "b", "a"]


def test_a_broken_snapshot_does_not_count(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    for p in "ab":
        store.append(enveloped(rows_of(spark, (p, p)), "n", None, "moments"))
        store.compact()
    (tmp_path / "s" / "snapshots" / "upto=1" / "_SUCCESS").unlink()
    assert sorted(r["payload"] for r in LogStore(spark, str(tmp_path / "s")).replay("n").collect()) == ["a", "b"]


def test_compaction_waits_for_open_batches(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    store.append(enveloped(rows_of(spark, ("1", "a")), "n", None, "moments"))
    lost = store.claim()
    store.append(enveloped(rows_of(spark, ("2", "b")), "n", None, "moments"))
    assert store.compact() == 0
    store.abandon(lost)
    assert store.compact() == 2 and store.replay("n").count() == 2


def test_tombstones_hide_one_family_of_one_partition(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    for ns in "ab":
        for fam in ("moments", "knowledge"):
            store.append(enveloped(rows_of(spark, ("1", ns)), ns, None, fam))
    store.append(enveloped(rows_of(spark, ("g", json.dumps({"family": "moments", "id": "1"}))), "a", None, "tombstones"))
    assert [r["family"] for r in store.replay("a").collect()] == ["knowledge"] and store.replay("b").count() == 2
    assert store.get("moments", "1", "a").count() == 0 and store.get("moments", "1", "b").count() == 1


def test_put_checks_partition_and_family(spark, tmp_path):
    told = []
    store = LogStore(spark, str(tmp_path / "s"), listener=told.append)
    schema = "namespace string, scope string, family string, id string, payload string"
    store.put(spark.createDataFrame([(None, None, "moments", "1", "x")], schema), "n", "s")
    assert [(r["namespace"], r["scope"], r["dedupe_key"].split(":")[0]) for r in store.scan().collect()] == [("n", "s", "n")]
    for bad in (("m", None, "moments", "1", "x"), (None, None, "nonsense", "1", "x")):
        with pytest.raises(Exception, match="foreign|unknown"):
            store.put(spark.createDataFrame([bad], schema), "n")
    assert [t["error"] is None for t in told] == [True, False, False]
    assert store.fold("n", "s", 0, lambda n, _: n + 1) == 1 and store.fold("n", "s", 0, lambda n, _: n + 1, lambda n: n >= 1) == 1
    rows = store.scan()
    assert decoded(encoded(rows)).exceptAll(rows).count() == 0


def test_routes_and_config(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    store.append(enveloped(rows_of(spark, ("1", "a")), "n", None, "moments"))
    seen, rows = [], store.scan()
    fail = Route("bad", lambda df: 1 / 0)
    good = Route("good", lambda df: seen.append(df.count()), ("moments",), primary=True)
    assert write_all(rows, [good, fail], strict=False)["bad"]
    with pytest.raises(RuntimeError):
        write_all(rows, [good, fail])
    assert seen == [1, 1]
    with pytest.raises(ValueError, match="unknown"):
        family("nonsense")
    cfg = StoreConfig([Route("a", print), Route("b", print, ("knowledge",)), Route("c", print, duplicate=False), Route("d", None)])
    assert [r.name for r in cfg.selected("moments")] == ["a"] and [r.name for r in cfg.selected("knowledge")] == ["a", "b"] and len(cfg.routes) == 3
    assert [r.name for r in StoreConfig(cfg.routes, "families", rules={"moments": ["c"]}).selected("moments")] == ["c"]
    for wrong in ({"mode": "some"}, {"compaction_limit": -1}):
        with pytest.raises(ValueError):
            StoreConfig([], **wrong)
    assert supports(store, "replay") and not supports(object(), "replay")
    with pytest.raises(NotImplementedError):
        Placeholder("jdbc").write(rows)
    assert compact(store, "all", lambda: "said") == {"semantic": "said", "physical": 0}
    with pytest.raises(ValueError):
        compact(store, "half")


def test_sources(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("TASK: write it\n# note\n\nplain words\n")
    assert [(r["type"], r["text"]) for r in read_lines(spark, str(tmp_path / "lines.txt")).collect()] == [("task", "write it"), ("text", "plain words")]
    (tmp_path / "r.jsonl").write_text(json.dumps({"family": "moments", "id": 1, "seq": 2, "payload": {"a": 1}}) + "\n{torn\n")
    spark.dataSource.register(RecordSource)
    assert [tuple(r) for r in spark.read.format("strataq_records").option("files", str(tmp_path / "r.jsonl")).load().collect()] == [("moments", "1", 2, '{"a": 1}')]


# Streams.


def batches(spark, src, schema, *parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        yield


def test_lifecycle_state_lives_across_batches(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "cp"), "memory_id long, seq long, state string"
    got = {}

    def keep(df, _):
        got.update({r["memory_id"]: r["state"] for r in df.collect()})

    for _ in batches(spark, src, schema, [(1, 0, "promoted"), (2, 0, "pinned")], [(1, 1, "candidate"), (2, 1, "stale")], [(1, 2, "forgotten")]):
        stream = S.lifecycle(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    assert got == {1: "forgotten", 2: "pinned"}


def test_facts_across_batches(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "fact_key string, seq long, kind string, memory_id string, value string, state string"
    parts = [[("k", 0, "claim", "a", "x", "short_term")], [("k", 1, "state", "a", "x", "pinned"), ("k", 2, "claim", "b", "y", "short_term")], [("k", 3, "claim", "c", "x", "short_term"), ("k", 4, "claim", "d", "z", "short_term")]]
    for _ in batches(spark, src, schema, *parts):
        out = S.drain(S.facts(spark.readStream.schema(schema).parquet(src)), "append", ["fact_key"], str(tmp_path / "state"))
    got = [(r["memory_id"], r["state"], r["reason"]) for r in out.orderBy("seq", "reason").collect()]
    assert got == [("a", "short_term", "fact_observed"), ("b", "candidate", "conflicts_with_pinned_fact"), ("c", "short_term", "fact_verified"), ("d", "promoted", "fact_replaced_previous"), ("c", "contradicted", "replaced_by_newer_fact")]


def test_write_through(spark, tmp_path):
    store, schema, told = LogStore(spark, str(tmp_path / "log")), "id string, payload string", []
    for _ in batches(spark, str(tmp_path / "in"), schema, [("1", "a")], [("1", "a"), ("2", "b")]):
        rows = enveloped(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "n", None, "moments")
        S.write_through(rows, store, str(tmp_path / "cp"), lambda df: told.append(df.count())).awaitTermination()
    assert sorted(r["id"] for r in store.scan().collect()) == ["1", "2"] and told == [1, 2]
