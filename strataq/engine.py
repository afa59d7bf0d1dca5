"""The memory engine's entry points over one log.

Every call takes and returns DataFrames or small driver values; rows live in a
LogStore, and reads derive everything else.  A namespace and a scope (null is a
partition of its own) bind one Memory.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import secrets as tokens
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataq.context import QueryContext
from strataq.functions import predicates as P
from strataq.functions import text as T
from strataq.functions import vectors as V
from strataq.operators import consolidation as C
from strataq.operators import embedding as E
from strataq.operators import forgetting as D
from strataq.operators import governance as G
from strataq.operators import graph as R
from strataq.operators import intake as I
from strataq.operators import knowledge as K
from strataq.operators import log as L
from strataq.operators import observations as O
from strataq.operators import recall as A
from strataq.operators import retrieval as Q
from strataq.operators import secrets as S
from strataq.operators import temporal as W
from strataq.sessions import cut
from strataq.sources.log_store import LogStore, enveloped, family

MOMENT = (
    "signal_id string, stream string, task_id string, kind string, text string, attention double, state string, title string, role string, root_id string, categories array<string>, canonical string, "
    "value_kind string, value string, display string, keywords array<string>, entities array<string>, fingerprint long, vector array<double>, label string, sealed string, " + ", ".join(f"{f} string" for f in W.FIELDS)
)
STATE = "memory_id string, state string, reason string, fact_key string, fact_value string, observed_at string, last_verified_at string"
EVENT = "type string, name string, summary string, text string, steps array<string>, source_id string, usage long, attention double"
#: Families that search looks through, and where their text stands.
INDEXED = ("moments", "knowledge", "summaries", "observations", "mental_models", "artifacts", "action_recipes")
DAY = 86_400_000


def new_id(prefix: str) -> str:
    """An id that begins with the time, so that ids sort by it, and ends at random."""
    return f"{prefix}_{time.time_ns() // 1_000_000:012x}{tokens.token_hex(10)}"


@dataclass
class Policy:
    """What a mission keeps of an intake, what it adds, and how much its roots count."""

    keep: Callable[[DataFrame], Column] = lambda docs: F.lit(True)
    priority: Callable[[Column], Column] = lambda text: F.lit(None).cast("double")


MISSIONS = {"code_agent": Policy(lambda docs: ~T.small_talk(F.col("text")), lambda text: T.technical_priority(T.technical_categories(text)))}


@dataclass
class Memory:
    """``key`` seals secrets, ``may_reveal`` says who opens them, ``model`` has rows (token, vector)."""

    spark: SparkSession
    path: str
    namespace: str
    scope: str | None = None
    key: bytes | None = None
    may_reveal: Callable[[DataFrame], Column] | None = None
    model: DataFrame | None = None
    listener: Callable[[dict], None] | None = None
    log: LogStore = field(init=False)
    events: LogStore = field(init=False)

    def __post_init__(self) -> None:
        if not self.namespace:
            raise ValueError("a namespace is needed")
        self.log = LogStore(self.spark, self.path, listener=self.listener)
        self.events = LogStore(self.spark, f"{self.path}/knowledge", listener=self.listener)

    # Writing.

    def envelope(self, df: DataFrame, family_: str) -> DataFrame:
        """Rows (id, and what is to be kept) as envelopes with a JSON payload."""
        fields = [c for c in df.columns if c != "id"]
        return enveloped(df.select("id", F.to_json(F.struct(*fields)).alias("payload")), self.namespace, self.scope, family(family_))

    def write(self, family_: str, rows: Sequence[tuple[str, dict[str, Any]]], once: bool = True, log: LogStore | None = None) -> list[str]:
        """Appends (id, payload) records and returns their ids."""
        df = self.spark.createDataFrame([(i, json.dumps(p, sort_keys=True)) for i, p in rows], "id string, payload string")
        (log or self.log).append(enveloped(df.coalesce(1), self.namespace, self.scope, family(family_)), once)
        return [i for i, _ in rows]

    def projected(self, rows: DataFrame) -> DataFrame:
        """Moments with keywords, entities and fingerprint of their text, and a vector if there is a model."""
        rows = rows.withColumns({"keywords": T.keywords(F.col("text")), "entities": T.entities(F.col("text")), "fingerprint": T.simhash(F.col("text"))})
        if self.model is None:
            return rows
        return rows.join(E.mean_pooled(rows, self.model, "id").select("id", "vector"), "id", "left")

    def signal(self, text: str, stream: str | None = None, task_id: str | None = None, kind: str = "text", attention: float = 1.0, state: str | None = None, **times: Any) -> str:
        """Records one memory; its lane is the stream, else the task, else chat.  The signal and the memory are one batch; its lifecycle follows."""
        if attention < 0:
            raise ValueError("attention is not negative")
        if state is not None and state not in P.STATES:
            raise ValueError(f"unknown state {state!r}")
        lane = stream or (f"task:{task_id}" if task_id else "chat")
        me, sig = new_id("mem"), new_id("sig")
        times = W.defaults(times, dt.datetime.now(dt.UTC))
        schema = "id string, signal_id string, stream string, task_id string, kind string, text string, attention double, state string, " + ", ".join(f"{f} string" for f in W.FIELDS)
        one = self.spark.createDataFrame([(me, sig, lane, task_id, kind, text, float(attention), state, *times.values())], schema).coalesce(1)
        signal = one.select(F.col("signal_id").alias("id"), F.col("text").alias("input"), "kind", "stream", "task_id")
        moment = self.projected(one.drop("state"))
        self.log.append(self.envelope(signal, "signals").unionByName(self.envelope(moment, "moments")).coalesce(1), once=False)
        self.observe(one.select("id", "text", "state"))
        return me

    def observe(self, new: DataFrame) -> None:
        """Writes the first states of new memories (id, text, state): what states a fact is governed by what held before."""
        claim = T.fact_claim(F.col("text"))
        rows = cut(new.select("id", F.coalesce("state", F.lit("short_term")).alias("state"), claim.alias("f")))
        plain = rows.filter("f IS NULL").select(F.col("id").alias("memory_id"), "state", F.lit("observed").alias("reason"), F.lit(None).cast("string").alias("fact_key"), F.lit(None).cast("string").alias("fact_value"))
        stated = rows.filter("f IS NOT NULL")
        if not stated.isEmpty():
            place = F.struct(F.lit(1).alias("new"), F.monotonically_increasing_id().alias("at"))
            told = stated.select(F.concat_ws(":", "f.subject", "f.attribute").alias("fact_key"), place.alias("seq"), F.lit("claim").alias("kind"), F.col("id").alias("memory_id"), F.col("f.value").alias("value"), "state")
            held = self.fact_states().select("fact_key", F.struct(F.lit(0).alias("new"), F.col("seq").alias("at")).alias("seq"), F.lit("state").alias("kind"), "memory_id", F.col("fact_value").alias("value"), "state")
            both = held.join(told.select("fact_key").distinct(), "fact_key", "left_semi").unionByName(told)
            order = (F.col("seq.new").cast("long") * F.lit(1 << 62) + F.col("seq.at")).alias("seq")
            governed = G.governed_facts(both.select("fact_key", order, "kind", "memory_id", "value", "state"))
            plain = plain.unionByName(governed.select("memory_id", "state", "reason", "fact_key", F.col("value").alias("fact_value")))
        self.append_states(plain)

    def append_states(self, rows: DataFrame) -> None:
        """Appends (memory_id, state, reason, fact_key, fact_value) events, observed now."""
        now = dt.datetime.now(dt.UTC).isoformat()
        rows = rows.withColumn("observed_at", F.lit(now)).withColumn("id", F.concat(F.lit("state_"), F.substring(F.sha2(F.concat_ws(":", "memory_id", "state", "reason", F.lit(new_id("at"))), 256), 1, 24)))
        self.log.append(self.envelope(rows, "memory_states"), once=False)

    def remember(self, docs: DataFrame, plugs: Sequence[Callable[[DataFrame], DataFrame | None]] = (), mission: str | Policy | None = None, extract: bool = True, mode: str = "classify") -> DataFrame:
        """Takes (id, text) rows in: roots, chunks, summaries, categories and extracted parts, and all links between them; returns the memories as (id, kind, text).

        A plug is a function of DataFrames that may filter or change rows, or halt the
        intake by returning nothing.  Rows whose column ``secret`` is true become sealed
        memories without chunks or extraction.  A mission's policy drops what it does not
        keep and sets the roots' attention.
        """
        none = self.spark.createDataFrame([], "id string, kind string, text string")
        docs = docs.filter(F.trim("text") != "")
        for plug in plugs:
            docs = plug(docs)
            if docs is None:
                return none
            if not {"id", "text"} <= set(getattr(docs, "columns", ())):
                raise ValueError("a plug returns rows with id and text, or nothing")
        policy = MISSIONS.get(mission, Policy()) if mission is None or isinstance(mission, str) else mission
        docs = docs.filter(F.coalesce(policy.keep(docs), F.lit(True)))
        if "secret" in docs.columns:
            self.remember_secrets(docs.filter(F.coalesce("secret", F.lit(False))))
            docs = docs.filter(~F.coalesce("secret", F.lit(False)))
        rows = cut(I.packets(docs, extract=extract, mode=mode))
        made = I.memories(rows)
        attention = F.when(F.col("role") == "root", F.coalesce(policy.priority(F.col("text")), F.col("attention"))).otherwise(F.col("attention"))
        streams = rows.select(F.col("id").alias("root_id"), "stream")
        moments = cut(self.projected(made.withColumn("attention", attention).join(streams, "root_id").withColumn("observed_at", F.lit(dt.datetime.now(dt.UTC).isoformat()))))
        links = I.links(rows)
        old = self.moments()
        others = old.select("id", F.coalesce("root_id", "id").alias("root_id"), "task_id", "keywords", "entities", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "kind", "canonical")
        # A root that is written again is no other memory.
        others = cut(others.join(moments.select("id"), "id", "left_anti"))
        cross = I.cross_links(I.anchors(rows), others.filter(F.coalesce("kind", F.lit("")) != "memory_category"))
        links = links.unionByName(cross.select("source_id", F.lit("related_memory").alias("relation"), "target_id", "weight"))
        names = lambda df: df.filter("kind = 'memory_entity' AND canonical IS NOT NULL").select("canonical", "id")
        first = names(others).groupBy("canonical").agg(F.min("id").alias("target_id"))
        same = names(moments).join(first, "canonical").select(F.col("id").alias("source_id"), F.lit("same_entity").alias("relation"), "target_id", F.lit(1.0).alias("weight"))
        links = links.unionByName(same).withColumn("id", F.concat(F.lit("edge_"), F.substring(F.sha2(F.concat_ws(":", "source_id", "relation", "target_id"), 256), 1, 24)))
        self.log.append(self.envelope(moments, "moments").unionByName(self.envelope(links, "associations")))
        self.observe(moments.select("id", F.when(F.col("role") == "root", F.col("text")).alias("text"), F.lit(None).cast("string").alias("state")))
        return moments.select("id", "kind", "text")

    def remember_secrets(self, docs: DataFrame) -> None:
        """Seals rows (id, text, and perhaps label) under the memory's key; only a label stays readable."""
        if docs.isEmpty():
            return
        if self.key is None:
            raise ValueError("a key is needed to keep secrets")
        docs = docs if "label" in docs.columns else docs.withColumn("label", F.lit(None).cast("string"))
        rows = S.sealed(docs.select(F.col("id").cast("string").alias("id"), "text", "label").withColumns({"namespace": F.lit(self.namespace), "scope": F.lit(self.scope).cast("string")}), self.key)
        rows = rows.select("id", "text", "label", F.base64("sealed").alias("sealed"), F.lit("secret").alias("kind"), F.lit("memory").alias("stream"), F.lit(1.0).alias("attention"))
        rows = cut(self.projected(rows))  # the nonce must not be drawn again
        self.log.append(self.envelope(rows, "moments"))
        self.observe(rows.select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("state")))

    def reveal(self, test: Column | str) -> DataFrame:
        """(id, label, text, locked) of secrets that a test or an id names; those whom the policy does not allow stay locked."""
        if self.key is None:
            raise ValueError("a key is needed to reveal secrets")
        rows = D.selected(self.moments(), test).filter("sealed IS NOT NULL").withColumn("sealed", F.unbase64("sealed")).withColumns({"namespace": F.lit(self.namespace), "scope": F.lit(self.scope).cast("string")})
        return S.revealed(rows, self.key, self.may_reveal).select("id", "label", "text", "locked")

    def link(self, source: str, relation: str, target: str, weight: float = 1.0) -> str:
        """An edge between two memories, artifacts or recipes of this partition; unknown ends are an error."""
        known = self.log.replay(self.namespace, self.scope, families=("moments", "signals", "artifacts", "action_recipes"))
        found = {r[0] for r in known.filter(F.col("id").isin(source, target)).select("id").collect()}
        if missing := {source, target} - found:
            raise KeyError(f"unknown memory {sorted(missing)}")
        content = hashlib.sha256(json.dumps([source, relation, target]).encode()).hexdigest()[:24]
        return self.write("associations", [(f"edge_{content}", {"source_id": source, "relation": relation, "target_id": target, "weight": weight})])[0]

    def unlink(self, edge_id: str) -> None:
        self.bury(self.spark.createDataFrame([("associations", edge_id)], "family string, id string"))

    def artifact(self, source: str, content_type: str = "text/plain", memory_id: str | None = None) -> str:
        """An artifact, tied to a memory if one is named."""
        me = self.write("artifacts", [(new_id("art"), {"source": source, "content_type": content_type})])[0]
        if memory_id is not None:
            self.link(memory_id, "has_artifact", me)
        return me

    def recipe(self, memory_id: str, text: str, language: str = "text", intent: str | None = None) -> str:
        """An action recipe attached to a memory: data, never run here."""
        one = self.spark.createDataFrame([(memory_id, text, language, intent)], "memory_id string, text string, language string, intent string")
        made, edges = K.recipes(one)
        me = made.first()["id"]
        self.log.append(self.envelope(made, "action_recipes"))
        self.link(memory_id, "attached_action", edges.first()["target_id"])
        return me

    def run_recipe(self, recipe_id: str, runtime: Callable[[dict[str, Any]], Any] | None = None) -> dict[str, Any]:
        """Hands a recipe to a runtime of the caller's; without one nothing runs."""
        row = self.records("action_recipes", "memory_id string, language string, text string, intent string, status string").filter(F.col("id") == recipe_id).first()
        if row is None:
            raise KeyError(recipe_id)
        recipe = row.asDict()
        return {"status": "inert", "recipe": recipe} if runtime is None else {"status": "run", "recipe": recipe, "result": runtime(recipe)}

    def set_state(self, memory_id: str, state: str, reason: str = "manual") -> bool:
        """Writes a state; False if the lifecycle does not allow it, or the memory is in it already."""
        if state not in P.STATES:
            raise ValueError(f"unknown state {state!r}")
        now = self.states().filter(F.col("memory_id") == memory_id).first()
        before = now["state"] if now is not None else None
        if before is not None and state not in P.TRANSITIONS[before]:
            return False
        fact = self.fact_states().filter(F.col("memory_id") == memory_id).select("fact_key", "fact_value").first()
        row = [(memory_id, state, reason, fact["fact_key"] if fact else None, fact["fact_value"] if fact else None)]
        self.append_states(self.spark.createDataFrame(row, "memory_id string, state string, reason string, fact_key string, fact_value string").coalesce(1))
        return True

    def decay(self, stale_after_ms: int = 30 * DAY, now: dt.datetime | None = None) -> int:
        """Marks facts that were not seen for so long as stale; returns how many."""
        before = W.cutoff(now or dt.datetime.now(dt.UTC), stale_after_ms)
        facts = self.fact_states().groupBy("memory_id").agg(F.max_by(F.struct("fact_key", "fact_value", "observed_at", "last_verified_at"), "seq").alias("f")).join(self.states(), "memory_id")
        rows = facts.select("memory_id", "state", "f.fact_key", "f.fact_value", W.normal(F.col("f.last_verified_at")).alias("last_verified"), W.normal(F.col("f.observed_at")).alias("observed"), F.lit(None).cast("timestamp").alias("inserted"))
        old = cut(G.stale(rows, before).select("memory_id", F.lit("stale").alias("state"), F.lit("freshness_decay").alias("reason"), "fact_key", "fact_value"))
        if n := old.count():
            self.append_states(old)
        return n

    def put_mental_model(self, title: str, query: str, answer: str, source_ids: Sequence[str] = (), **times: Any) -> str:
        one = self.spark.createDataFrame([(title, query, answer)], "title string, query string, answer string")
        me = K.mental_models(one, self.namespace, self.scope).first()["id"]
        times = {k: v for k, v in W.defaults(times, dt.datetime.now(dt.UTC)).items() if v is not None and k != "observed_at"}
        return self.write("mental_models", [(me, {"title": title, "query": query, "answer": answer, "source_ids": list(source_ids), **times})])[0]

    def learn(self, text: str) -> dict[str, Any]:
        """A skill from text: its name and steps."""
        row = K.skills(self.spark.createDataFrame([(text,)], "text string")).select("name", "steps").first()
        if row is None:
            raise ValueError("empty skill")
        out = {"type": "skill", "name": row["name"], "steps": row["steps"], "text": text[:2000]}
        self.write("knowledge", [(new_id("skill"), out)], False, self.events)
        return out

    def bury(self, graves: DataFrame, log: LogStore | None = None) -> None:
        """Tombstones for (family, id) rows of this partition."""
        rows = graves.select(F.concat_ws("/", "family", "id").alias("id"), F.to_json(F.struct("family", "id")).alias("payload"))
        (log or self.log).append(enveloped(rows, self.namespace, self.scope, "tombstones"))

    def forget(self, selector: Column | str | tuple[str, str]) -> int:
        """Buries the memories that a selector names and all that refers to them, and ends their lifecycles; returns how many memories."""
        hit = cut(D.selected(self.moments(), selector).select("id", "signal_id"))
        n = hit.count()
        if not n:
            return 0
        own = self.log.replay(self.namespace, self.scope)
        self.bury(cut(D.targets(hit, self.edges(), own.select("family", "id", "payload"))))
        learned = D.targets(hit, self.edges().limit(0), self.events.replay(self.namespace, self.scope).select("family", "id", "payload")).filter("family = 'knowledge'")
        learned = cut(learned)
        if not learned.isEmpty():
            self.bury(learned, self.events)
        none = F.lit(None).cast("string")
        self.append_states(hit.select(F.col("id").alias("memory_id"), F.lit("forgotten").alias("state"), F.lit("forgotten").alias("reason"), none.alias("fact_key"), none.alias("fact_value")))
        return n

    # Reading.

    def records(self, family_: str, schema: str, log: LogStore | None = None) -> DataFrame:
        rows = (log or self.log).replay(self.namespace, self.scope, families=(family_,))
        return rows.select("id", "seq", F.from_json("payload", schema).alias("_p")).select("id", "seq", "_p.*")

    def state_events(self) -> DataFrame:
        return self.records("memory_states", STATE)

    def states(self) -> DataFrame:
        """(memory_id, state) after all legal moves."""
        return G.folded_state(self.state_events().select("memory_id", "seq", "state"), block=1 << 24)

    def fact_states(self) -> DataFrame:
        """State events of memories that state a fact; the key and value hold for all of a memory's later events."""
        e = self.state_events()
        keys = e.filter("fact_key IS NOT NULL").groupBy("memory_id").agg(F.max_by(F.struct("fact_key", "fact_value"), "seq").alias("_f"))
        return e.drop("fact_key", "fact_value").join(keys, "memory_id").select("memory_id", "seq", "state", "reason", "observed_at", "last_verified_at", "_f.*")

    def moments(self) -> DataFrame:
        rows = self.records("moments", MOMENT)
        rows = rows.withColumns({f: W.normal(F.col(f)) for f in W.FIELDS})
        return rows.withColumnRenamed("state", "_own").join(self.states().withColumnRenamed("memory_id", "id"), "id", "left").withColumn("state", F.coalesce("state", "_own")).drop("_own")

    def edges(self) -> DataFrame:
        return self.records("associations", "source_id string, relation string, target_id string, weight double")

    def documents(self) -> DataFrame:
        """(family, id, seq, text, state) of all that search looks through."""
        rows = self.log.replay(self.namespace, self.scope, families=INDEXED)
        at = lambda f: F.get_json_object("payload", f"$.{f}")
        both = F.nullif(F.concat_ws(" ", at("query"), at("answer")), F.lit(""))
        text = F.coalesce(at("text"), at("summary"), at("statement"), both, at("name"), F.lit(""))
        vector = F.from_json(at("vector"), "array<double>")
        subject = F.coalesce(at("memory_id"), at("source_id"), F.col("id"))
        rows = rows.select("family", "id", "seq", text.alias("text"), vector.alias("vector"), F.when(F.col("family") == "moments", F.col("id")).otherwise(subject).alias("memory_id"), at("state").alias("_own"))
        return rows.join(self.states(), "memory_id", "left").withColumn("state", F.coalesce("state", "_own")).drop("_own", "memory_id")

    def cue_vector(self, cue: str) -> list[float] | None:
        if self.model is None:
            return None
        row = E.mean_pooled(self.spark.createDataFrame([("cue", cue)], "id string, text string"), self.model, "id", few=True).first()
        return list(row["vector"]) if row is not None else None

    def durable(self, cue: str, limit: int = 10) -> DataFrame:
        """Hybrid search of the log: rank, family, id, score, state, text."""
        rows = Q.hybrid(self.documents(), cue, vector=self.cue_vector(cue))
        return Q.top(rows, limit, F.desc("score"), F.desc("seq"), F.col("id")).select("rank", "family", "id", "score", "state", "text")

    def search(self, cue: str, limit: int = 10) -> DataFrame:
        """What recall finds, then what the log's index finds, each with its own ranks: source, rank, family, id, score, state, text."""
        active = self.recall(cue, limit).select(F.lit("active").alias("source"), "rank", F.lit("moments").alias("family"), "id", "score", "state", "text")
        return active.unionByName(self.durable(cue, limit).withColumn("source", F.lit("durable")))

    def context(self, cue: str) -> QueryContext:
        """A cue worked out once, for this partition."""
        vector = self.cue_vector(cue)
        return QueryContext(cue, self.namespace, self.scope, None if vector is None else tuple(vector))

    def recall(self, cue: str | QueryContext, limit: int = 10, budget: str = "mid", max_tokens: int | None = None, **filters: Any) -> DataFrame:
        """Scored memories, their graph neighbours and near vectors in one ranking: rank, id, kind, score, state, text.

        A cue may be a context that was made before, of this partition.  ``budget`` is low, mid or high.  ``filters`` bound when a memory occurred or was
        observed, and ask for what was valid at a time.  With ``max_tokens``, the ranking goes
        on until that many estimated tokens are used, instead of to the limit.
        """
        if limit < 0 or max_tokens is not None and max_tokens < 0:
            raise ValueError("limits are not negative")
        context = cue.ensure(self.namespace, self.scope) if isinstance(cue, QueryContext) else self.context(cue)
        cue, vector = context.text, context.vector
        seeds, depth = A.budget(budget)
        rows = cut(self.moments().filter(P.visible(F.col("state")) & W.matches(filters)))
        scored = cut(Q.active_scores(rows, cue, vector=vector))
        base = Q.top(scored, limit * seeds, F.desc("score"), F.col("seq"), F.col("id")).select("id", "rank")
        near = R.reach(self.edges(), base.select(F.col("id").alias("node")), depth)
        lists = [base, near.select(F.col("node").alias("id"), (F.col("depth") + 1).alias("rank"))]
        fused = Q.fuse(lists, "id").withColumnRenamed("score", "_fused")
        found = rows.join(fused, "id").join(scored.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        order = (F.desc("score"), F.col("seq"), F.col("id"))
        found = A.reranked(found, cue)
        if max_tokens is None:
            return Q.top(found, limit, *order).select("rank", "id", "kind", "score", "state", "text")
        ranked = Q.numbered(found, *order)
        priced = ranked.select(F.lit(1).alias("grp"), F.col("rank").alias("pos"), T.token_estimate(F.col("text")).alias("cost"), "id", "kind", "score", "state", "text")
        return Q.budgeted(priced, max_tokens).select(F.col("pos").alias("rank"), "id", "kind", "score", "state", "text")

    def around(self, ids: DataFrame) -> dict[str, DataFrame]:
        """What belongs to memories (column id): edges, artifacts, recipes and statuses."""
        node, edges = ids.select(F.col("id").alias("node")), self.edges()
        rows = self.moments().join(ids.select("id").distinct(), "id", "left_semi")
        arts = self.records("artifacts", "source string, content_type string")
        recipes = self.records("action_recipes", "memory_id string, language string, text string, intent string, status string")
        keys = A.statuses(rows).select("by", "name")
        return {"edges": R.incident(edges, node), "artifacts": A.artifacts_for(edges, node, arts), "recipes": A.recipes_for(edges, node, recipes), "status": self.status().join(keys, ["by", "name"], "left_semi")}

    def status(self) -> DataFrame:
        """The latest memory of every stream and of every task: by, name, stream, task_id, kind, text, seq."""
        return A.statuses(self.moments())

    def claims(self) -> DataFrame:
        return self.moments().filter(P.visible(F.col("state"))).select("id", F.inline(T.claims(F.col("text"))))

    def facts(self) -> DataFrame:
        f = self.moments().select(F.col("seq").alias("id"), F.col("id").alias("memory_id"), T.fact_claim(F.col("text")).alias("f")).filter("f IS NOT NULL")
        return f.select("id", "memory_id", F.concat_ws(":", "f.subject", "f.attribute").alias("fact_key"), "f.subject", "f.attribute", "f.value")

    def current_observations(self) -> DataFrame:
        """id, type, statement, counts, confidence, trend and state of what the memories say."""
        facts = O.fact_observations(self.facts()).withColumn("type", F.lit("fact"))
        typed = O.typed_observations(self.claims()).withColumn("contradiction_count", F.lit(0).cast("long"))
        cols = ["type", "statement", "proof_count", "contradiction_count", "confidence", "trend", "state"]
        rows = facts.select(*cols).unionByName(typed.select(*cols))
        content = F.concat_ws(":", F.lit(self.namespace), F.coalesce(F.lit(self.scope), F.lit("-")), "type", "statement")
        return rows.withColumn("id", F.concat(F.lit("obs_"), F.substring(F.sha2(content, 256), 1, 24))).select("id", *cols)

    OBSERVATION = "type string, statement string, proof_count long, contradiction_count long, confidence double, trend string, state string"

    def consolidate_observations(self) -> DataFrame:
        """Writes the observations, and returns them; an unchanged one isn't written again."""
        rows = cut(self.current_observations())
        self.log.append(self.envelope(rows, "observations"))
        return rows

    def observations(self) -> DataFrame:
        """Written observations, then those that memories give anew, by id the written one."""
        old, new = self.records("observations", self.OBSERVATION).drop("seq"), self.current_observations()
        return old.unionByName(new.join(old.select("id"), "id", "left_anti"))

    def verify_observation(self, observation_id: str, relation: str) -> DataFrame:
        """Adds one piece of evidence (supports, weakens or contradicts) to an observation and returns it."""
        if relation not in ("supports", "weakens", "contradicts"):
            raise ValueError(f"unknown relation {relation!r}")
        row = self.observations().filter(F.col("id") == observation_id)
        if row.isEmpty():
            raise KeyError(observation_id)
        check = self.spark.createDataFrame([(observation_id, 0, relation)], "key string, seq long, relation string")
        new = O.verified(row.withColumnRenamed("id", "key"), check).withColumnRenamed("key", "id").join(row.select("id", "type", "statement"), "id")
        new = cut(new.select("id", "type", "statement", "proof_count", "contradiction_count", "confidence", "trend", "state"))
        self.log.append(self.envelope(new, "observations"))
        return new

    def search_observations(self, cue: str, limit: int = 10) -> DataFrame:
        """Twice the shared keywords, three times the shared names, and the confidence: rank, id, type, statement, score."""
        rows = self.observations().filter(P.visible(F.col("state")))
        rows = rows.withColumn("_k", O.overlap(F.col("statement"), cue)).filter("_k > 0").withColumn("score", F.col("_k") + F.col("confidence"))
        return Q.top(rows.drop("_k"), limit, F.desc("score"), F.col("id"))

    def mental_models(self, **filters: Any) -> DataFrame:
        rows = self.records("mental_models", "title string, query string, answer string, source_ids array<string>, " + ", ".join(f"{f} string" for f in W.FIELDS))
        return rows.withColumns({f: W.normal(F.col(f)) for f in W.FIELDS}).filter(W.matches(filters))

    def search_mental_models(self, cue: str, limit: int = 10) -> DataFrame:
        want = F.array(*[F.lit(t) for t in Q.cue_terms(cue)]).cast("array<string>")
        rows = self.mental_models().withColumn("score", F.size(F.array_intersect(T.keywords(F.concat_ws(" ", "title", "query", "answer"), 2), want))).filter("score > 0")
        return Q.top(rows, limit, F.desc("score"), F.col("id")).select("rank", "id", "title", "answer", "source_ids", "score")

    def reflect(self, cue: str, limit: int = 5, **filters: Any) -> tuple[DataFrame, float]:
        """Evidence for a cue (place, type, id, claim, source_ids): models, observations, memories; and how sure it makes."""
        m, o, r = (cut(x) for x in (self.search_mental_models(cue, limit), self.search_observations(cue, limit), self.recall(cue, limit, **filters)))
        models, observations, memories = m.count(), o.count(), r.count()
        sure = 0.9 if models else min(0.85, 0.4 + 0.1 * observations) if observations else min(0.7, 0.25 + 0.08 * memories) if memories else 0.0
        return A.evidence(m, o, r), sure

    # Knowledge: a log of its own.

    def knowledge(self) -> DataFrame:
        rows = self.records("knowledge", EVENT, self.events)
        return rows.withColumns({"usage": F.coalesce("usage", F.lit(0).cast("long")), "attention": F.coalesce("attention", F.lit(0.0)), "bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long")})

    def append_knowledge(self, rows: DataFrame) -> None:
        """Appends events (type, text, and perhaps name, summary, steps, source_id), normalised."""
        self.events.append(self.envelope(K.normalised(rows), "knowledge"), once=False)

    def replace_knowledge(self, rows: DataFrame) -> None:
        """Replaces this partition's events; those of other partitions stay.  Old events are buried in the batch that brings the new ones."""
        old = self.events.replay(self.namespace, self.scope, families=("knowledge",)).select(F.concat_ws("/", F.lit("knowledge"), "id").alias("id"), F.to_json(F.struct(F.lit("knowledge").alias("family"), "id")).alias("payload"))
        new = self.envelope(K.normalised(rows), "knowledge")
        self.events.append(cut(new.unionByName(enveloped(old, self.namespace, self.scope, "tombstones"))), once=False)

    def load_knowledge(self, limit: int = 20, budget: int = 16_384) -> DataFrame:
        return K.budget_per_type(self.knowledge(), limit, budget)

    def search_knowledge(self, cue: str, limit: int = 10) -> DataFrame:
        return Q.top(K.searched(self.knowledge(), cue), limit, F.desc("score"), F.desc("seq"), F.col("id")).select("rank", "id", "type", "name", "score")

    def compact_knowledge(self, adapter: Callable[[DataFrame, DataFrame], DataFrame] | None = None, latest: int = 20) -> str:
        """Replaces the knowledge by its compaction, the default one or an adapter's, and a marker; returns the summary."""
        moments, events = self.moments().filter(P.visible(F.col("state"))), self.knowledge()
        rows = cut(adapter(moments, events) if adapter else C.compacted_knowledge(moments, events, latest))
        marker = self.spark.createDataFrame([("compaction_marker", f"knowledge compacted: {rows.count()} events")], "type string, text string")
        self.replace_knowledge(rows.select(*[c for c in rows.columns if c != "seq"]).unionByName(marker, allowMissingColumns=True))
        row = rows.filter("type = 'summary'").first()
        return row["summary"] if row is not None else ""

    # Maintenance.

    def consolidate(self, least: float = 1.0, depth: int = 1, adapter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Promotes the memories worth keeping and their neighbours, and returns (id, window): connected components, the newest first.

        Writes knowledge, summaries, categories and embeddings, a job, and the promotions.
        ``adapter`` may change what is written: (family, id, source_id, text) rows.
        """
        if least < 0 or depth < 0:
            raise ValueError("a threshold and a depth are not negative")
        rows = cut(self.moments().filter(P.consolidatable(F.col("state"))))
        picked = rows.filter(F.col("attention") >= least).select(F.col("id").alias("node"))
        edges = cut(self.edges())
        known = rows.select(F.col("id").alias("node"), "seq", "stream", "task_id", "text")
        inside = edges.join(known.select(F.col("node").alias("source_id")), "source_id", "left_semi").join(known.select(F.col("node").alias("target_id")), "target_id", "left_semi")
        nodes = cut(R.reach(inside, picked, depth).select("node").join(known, "node"))
        if nodes.isEmpty():
            return self.spark.createDataFrame([], "id string, window long")
        inside = inside.join(nodes.select(F.col("node").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("node").alias("target_id")), "target_id", "left_semi")
        labelled = cut(R.components(nodes, inside).join(nodes, "node"))
        windows = cut(C.windows(labelled, inside))
        kept = rows.join(nodes.select(F.col("node").alias("id")), "id", "left_semi")
        made = C.outputs(kept)
        made = cut(adapter(made) if adapter else made)
        unknown = made.filter(~F.col("family").isin("knowledge", "summaries", "categories", "embeddings", "tombstones")).select("family").first()
        if unknown is not None:
            raise ValueError(f"consolidation can't write {unknown['family']!r}")
        whole = None
        for name in ("knowledge", "summaries", "categories", "embeddings"):
            part = self.envelope(made.filter(F.col("family") == name).select("id", "source_id", "text"), name)
            whole = part if whole is None else whole.unionByName(part)
        self.log.append(whole)
        job = C.job(made, kept.count(), inside.count(), windows.count()).withColumn("id", F.lit(new_id("conjob")))
        self.log.append(self.envelope(job, "consolidation_jobs"), once=False)
        none = F.lit(None).cast("string")
        self.append_states(kept.select(F.col("id").alias("memory_id"), F.lit("promoted").alias("state"), F.lit("consolidated").alias("reason"), none.alias("fact_key"), none.alias("fact_value")))
        return labelled.join(windows.select("component", F.col("rank").alias("window")), "component").select(F.col("node").alias("id"), "window")

    def semantic_compaction(self, families: Sequence[str] = ("moments", "knowledge", "summaries", "associations"), limit: int = 1000, adapter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(family, count, source_ids) of the strongest records of some families."""
        return C.semantic(self.log.replay(self.namespace, self.scope), list(families), limit, adapter)

    def maintain(self, now: dt.datetime | None = None, stale_after_ms: int = 30 * DAY) -> dict[str, Any]:
        """One tick: consolidates, decays and compacts; a step that fails does not keep the others from running."""
        out: dict[str, Any] = {}
        steps = {"consolidated": lambda: self.consolidate().count(), "stale": lambda: self.decay(stale_after_ms, now), "compacted": self.log.compact}
        for name, step in steps.items():
            try:
                out[name] = step()
            except Exception as e:  # told, and the next step goes on
                out[name] = e
        return out

    def evaluate(self, cases: DataFrame, limit: int = 10) -> DataFrame:
        """(label, n, hit_rate) of searches: cases have cue, token and label; a hit is a result whose text holds the token.

        Each case is a search of its own, so they are few.
        """
        hits = []
        for c in cases.collect():
            found = self.search(c["cue"], limit).filter(F.contains(F.col("text"), F.lit(c["token"])))
            hits.append((c["label"], not found.isEmpty()))
        return A.hit_rates(self.spark.createDataFrame(hits, "label string, hit boolean"))
