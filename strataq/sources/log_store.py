"""The durable log as Parquet folders: append, replay, lookup, compaction, routing.

Nothing of a log's state lives in a session.  Its folder holds

    claims/<n>          a file that claims batch n; created only if it isn't there
    log/batch=<n>/      the rows of batch n, by namespace and family
    snapshots/upto=<n>/ what batches up to n come to, tombstones applied

A reader takes the latest whole snapshot and the batches behind it, so a log that is
opened again, by any session, goes on where it was.  A row's ``seq`` is its batch's
number and its place there, which orders rows across sessions.  A batch or snapshot
without Spark's ``_SUCCESS`` mark doesn't count.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataq.operators import log as L
from strataq.sessions import cut, remove_folder

# Record families.
FAMILIES = ("signals", "moments", "associations", "artifacts", "action_recipes", "knowledge", "summaries", "categories", "embeddings", "observations", "mental_models", "memory_states", "consolidation_jobs", "tombstones", "secrets")
SCHEMA = "namespace string, scope string, family string, id string, operation string, dedupe_key string, payload string, digest string, seq long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
BATCH, ROWS, PARTS = 40, 24, 16


def family(name: str) -> str:
    """A known family, or an error."""
    if name not in FAMILIES:
        raise ValueError(f"unknown family {name!r}")
    return name


def scope_mark(scope: Column) -> Column:
    """A short hash of the scope; no scope has a mark of its own, which no hash equals."""
    return F.when(scope.isNull(), F.lit("-")).otherwise(F.substring(F.sha2(scope, 256), 1, 16))


def dedupe_key(id_: Column, namespace: Column, scope: Column, family_: Column, operation: Column) -> Column:
    return F.concat_ws(":", namespace, scope_mark(scope), family_, operation, id_)


def enveloped(df: DataFrame, namespace: str, scope: str | None, family_: str, operation: str = "put") -> DataFrame:
    """Rows (id, payload) with the envelope's columns; the key is namespace, scope mark, family, operation and id."""
    out = df.select(F.lit(namespace).alias("namespace"), F.lit(scope).cast("string").alias("scope"), F.lit(family(family_)).alias("family"), F.col("id").cast("string").alias("id"), F.lit(operation).alias("operation"), F.col("payload").cast("string").alias("payload"))
    return completed(out)


def completed(records: DataFrame) -> DataFrame:
    """Pre-built envelopes with what is missing filled in: operation, key, digest."""
    cols = set(records.columns)
    have = lambda name, other: F.coalesce(F.col(name), other) if name in cols else other
    out = records.withColumn("operation", have("operation", F.lit("put"))).withColumn("payload", F.col("payload").cast("string"))
    own = dedupe_key(F.col("id"), F.col("namespace"), F.col("scope"), F.col("family"), F.col("operation"))
    return out.withColumn("dedupe_key", have("dedupe_key", own)).withColumn("digest", F.md5(F.coalesce("payload", F.lit("")))).select(*[c for c in COLUMNS if c != "seq"])


def assigned(records: DataFrame, namespace: str, scope: str | None) -> DataFrame:
    """Records bound to one partition: a missing namespace or scope is filled in, a foreign one is an error."""
    foreign = lambda name, value: F.when(F.col(name).isNull(), F.lit(value)).when(F.col(name).eqNullSafe(F.lit(value)), F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"foreign {name}: "), F.col(name))).cast("string"))
    return records.withColumn("namespace", foreign("namespace", namespace)).withColumn("scope", foreign("scope", scope))


def encoded(rows: DataFrame) -> DataFrame:
    """JSON-safe records: the whole row as base64 text, beside the columns that stores index."""
    term = F.base64(F.encode(F.to_json(F.struct(*rows.columns)), "UTF-8"))
    return rows.select("namespace", "scope", "family", "id", "dedupe_key", term.alias("term"))


def decoded(rows: DataFrame, schema: str = SCHEMA) -> DataFrame:
    return rows.select(F.from_json(F.decode(F.unbase64("term"), "UTF-8"), schema).alias("_r")).select("_r.*")


@dataclass
class LogStore:
    """One Parquet log.  ``keep`` snapshots stay, with the batches behind the oldest of them."""

    spark: SparkSession
    path: str
    keep: int = 2
    listener: Callable[[dict], None] | None = None

    capabilities = frozenset(("append", "replay", "replay_fold", "lookup", "compact"))

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(conf), path

    def _numbers(self, folder: str, prefix: str = "", whole: bool = True) -> list[int]:
        """The numbers in the names of a folder's entries; of those that Spark has finished, if ``whole``."""
        fs, path = self._files()
        at = path(f"{self.path}/{folder}")
        if not fs.exists(at):
            return []
        found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(at)]
        found = [(n.removeprefix(prefix), p) for n, p in found if n.startswith(prefix) and n.removeprefix(prefix).isdigit()]
        return sorted(int(n) for n, p in found if not whole or fs.exists(path(f"{p}/_SUCCESS")))

    def claim(self) -> int:
        """The next batch number, which no other session gets."""
        fs, path = self._files()
        n = max([-1, *self._numbers("claims", whole=False)]) + 1
        while not fs.createNewFile(path(f"{self.path}/claims/{n}")):
            n += 1
        return n

    def batches(self) -> list[int]:
        return self._numbers("log", "batch=")

    def snapshot(self) -> int | None:
        """The batch up to which the latest whole snapshot reaches."""
        return max(self._numbers("snapshots", "upto="), default=None)

    def abandon(self, batch: int) -> None:
        """Gives up a batch whose writer is gone, so that compaction needs not wait for it: it has no rows."""
        fs, path = self._files()
        folder = path(f"{self.path}/log/batch={batch}")
        fs.delete(folder, True)
        fs.create(path(folder, "_SUCCESS")).close()

    def append(self, rows: DataFrame, once: bool = True) -> int:
        """Writes enveloped rows as one batch and returns its number.

        ``once``: a row whose payload equals the latest one of its key isn't written, so
        that A, A, B, A leaves three rows; a batch may repeat a key, too.  The place of a
        row in its batch is its partition's number and its place there.
        """
        began, n = time.time(), self.claim()
        mid = F.monotonically_increasing_id()
        part, row = F.shiftright(mid, 33), mid.bitwiseAND((1 << 33) - 1)
        fits = (row < (1 << ROWS)) & (part < (1 << PARTS))
        place = F.when(fits, F.shiftleft(part, ROWS) + row).otherwise(F.raise_error(F.lit("too many rows for one batch")).cast("long"))
        rows = rows.withColumn("seq", F.lit(n << BATCH) + place).select(*COLUMNS)
        try:
            if once:
                rows = cut(rows)  # places are given once, for the comparison reads them twice
                rows = L.changed(rows, before=self._last(rows))
            rows.write.mode("overwrite").partitionBy("namespace", "family").parquet(f"{self.path}/log/batch={n}")
        except Exception as e:
            self.abandon(n)
            self._tell(n, time.time() - began, str(e))
            raise
        self._tell(n, time.time() - began, None)
        return n

    def _tell(self, batch: int, seconds: float, error: str | None) -> None:
        if self.listener is not None:
            self.listener({"event": "write", "batch": batch, "seconds": seconds, "error": error})

    def _last(self, rows: DataFrame) -> DataFrame:
        """(dedupe_key, digest) of the latest record of the keys that ``rows`` writes."""
        where = rows.select("namespace", "family").distinct().collect()  # a batch has few of them
        test = F.lit(False)
        for r in where:
            test = test | ((F.col("namespace") == r["namespace"]) & (F.col("family") == r["family"]))
        old = self.scan().filter(test).join(rows.select("dedupe_key").distinct(), "dedupe_key", "left_semi")
        return old.groupBy("dedupe_key").agg(F.max_by("digest", "seq").alias("digest"))

    def put(self, records: DataFrame, namespace: str, scope: str | None = None) -> int:
        """Appends pre-built envelopes of one partition; unknown families and foreign partitions are errors."""
        known = F.when(F.col("family").isin(*FAMILIES), F.col("family")).otherwise(F.raise_error(F.concat(F.lit("unknown family "), F.col("family"))).cast("string"))
        return self.append(completed(assigned(records, namespace, scope).withColumn("family", known)))

    def scan(self) -> DataFrame:
        """All rows: the latest snapshot, then the batches behind it."""
        upto, parts = self.snapshot(), []
        if upto is not None:
            parts.append(self._read(f"{self.path}/snapshots/upto={upto}", [f"{self.path}/snapshots/upto={upto}"]))
        if later := [n for n in self.batches() if upto is None or n > upto]:
            parts.append(self._read(f"{self.path}/log", [f"{self.path}/log/batch={n}" for n in later]))
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _read(self, base: str, folders: list[str]) -> DataFrame:
        """One scan of all folders; namespace and family are parts of the paths, so that filters on them skip files."""
        return self.spark.read.schema(f"{SCHEMA}, batch long").option("basePath", base).parquet(*folders).select(*COLUMNS)

    def tombstones(self, rows: DataFrame | None = None) -> DataFrame:
        """(namespace, scope, family, id) of what is buried."""
        t = (self.scan() if rows is None else rows).filter("family = 'tombstones'")
        return t.select("namespace", "scope", F.get_json_object("payload", "$.family").alias("family"), F.get_json_object("payload", "$.id").alias("id"))

    def replay(self, namespace: str, scope: str | None = None, all_scopes: bool = False, families: Sequence[str] = ()) -> DataFrame:
        """Latest row of every key, without buried ones, of one partition or of all scopes of a namespace."""
        own = self.scan().filter(F.col("namespace") == namespace)
        if not all_scopes:
            own = own.filter(F.col("scope").eqNullSafe(F.lit(scope)))
        rows = own.filter(F.col("family").isin(*families) if families else F.col("family") != "tombstones")
        return L.without_tombstones(L.latest(rows), self.tombstones(own))

    def fold(self, namespace: str, scope: str | None, start, step: Callable, halt: Callable = lambda _: False):
        """Folds a partition's rows in order on the driver, row by row, until ``halt`` holds; rows come partition by partition."""
        state = start
        for r in self.replay(namespace, scope).orderBy("seq").toLocalIterator():
            state = step(state, r)
            if halt(state):
                break
        return state

    def get(self, family_: str, id_: str, namespace: str, scope: str | None = None) -> DataFrame:
        """The latest row of one record of a partition, unless it is buried."""
        own = self.scan().filter((F.col("namespace") == namespace) & F.col("scope").eqNullSafe(F.lit(scope)))
        rows = own.filter((F.col("family") == family_) & (F.col("id") == id_))
        return L.without_tombstones(rows, self.tombstones(own)).orderBy(F.desc("seq")).limit(1)

    def compact(self) -> int | None:
        """Writes a snapshot of what a replay shows and returns up to which batch; tombstones go.

        Batches that are being written stay behind it.  Older snapshots and the batches that
        only they need are removed, but for ``keep`` of them.
        """
        done, claimed = set(self.batches()), self._numbers("claims", whole=False)
        open_ = [n for n in claimed if n not in done and n > (self.snapshot() if self.snapshot() is not None else -1)]
        upto = min(open_) - 1 if open_ else max([*claimed, -1])
        if upto < 0 or upto == self.snapshot():
            return self.snapshot()
        rows = self.scan().filter(F.col("seq") < F.lit((upto + 1) << BATCH))
        kept = L.compacted(rows.filter("family <> 'tombstones'"), self.tombstones(rows))
        fs, path = self._files()
        new = f"{self.path}/snapshots/_new-{uuid.uuid4().hex}"
        kept.write.partitionBy("namespace", "family").parquet(new)
        if not fs.rename(path(new), path(f"{self.path}/snapshots/upto={upto}")):
            raise RuntimeError(f"snapshot {upto} is there already")
        self._clean()
        return upto

    def _clean(self) -> None:
        stay = self._numbers("snapshots", "upto=")[-self.keep :]
        for n in self._numbers("snapshots", "upto=", whole=False):
            if n < stay[0]:
                remove_folder(self.spark, f"{self.path}/snapshots/upto={n}")
        for n in self._numbers("log", "batch=", whole=False):
            if n <= stay[0]:
                remove_folder(self.spark, f"{self.path}/log/batch={n}")


@dataclass
class Placeholder:
    """A connector that is only declared: what it will do is known, and every call is an error."""

    name: str
    capabilities = frozenset(("append", "replay", "lookup", "search"))

    def write(self, rows: DataFrame) -> None:
        raise NotImplementedError(f"the {self.name} connector isn't implemented; write with spark.write instead")


def supports(store: object, what: str) -> bool:
    """Whether a store says that it can do something; anything but a set of names counts as no."""
    said = getattr(store, "capabilities", None)
    return isinstance(said, (set, frozenset)) and what in said


@dataclass
class Route:
    """A sink with the families it takes (none: all)."""

    name: str
    write: Callable[[DataFrame], None]
    families: Sequence[str] = field(default_factory=tuple)
    primary: bool = False
    duplicate: bool = True


@dataclass
class StoreConfig:
    """Where records go and what failures mean.  Without a primary, the first route is one; routes that can't write are dropped."""

    routes: Sequence[Route]
    mode: str = "all"
    strict: bool = True
    compaction_families: Sequence[str] = ("moments", "knowledge", "summaries", "categories", "embeddings", "associations", "artifacts", "action_recipes")
    compaction_limit: int = 1000
    rules: dict[str, Sequence[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("all", "primary_only", "families"):
            raise ValueError(f"unknown write mode {self.mode!r}")
        if self.compaction_limit < 0:
            raise ValueError("a limit is not negative")
        self.routes = [r for r in self.routes if callable(r.write)]
        if self.routes and not any(r.primary for r in self.routes):
            first = self.routes[0]
            self.routes[0] = Route(first.name, first.write, first.families, True, first.duplicate)

    def selected(self, family_: str) -> list[Route]:
        """The routes that a family's records take."""
        takes = [r for r in self.routes if not r.families or family_ in r.families]
        if self.mode == "primary_only":
            return [r for r in takes if r.primary]
        if self.mode == "families" and family_ in self.rules:
            return [r for r in self.routes if r.name in self.rules[family_]]
        return [r for r in takes if r.primary or r.duplicate]


def write_all(rows: DataFrame, routes: Sequence[Route], mode: str = "all", strict: bool = True) -> dict[str, str | None]:
    """Writes rows to every sink that takes them; returns errors by sink.

    ``primary_only`` writes to primaries alone.  Strict: any error raises; best
    effort: only a primary's does.
    """
    out: dict[str, str | None] = {}
    for r in routes:
        if mode == "primary_only" and not r.primary:
            continue
        try:
            r.write(rows.filter(F.col("family").isin(*r.families)) if r.families else rows)
            out[r.name] = None
        except Exception as e:  # each sink's failure is weighed by the policy below
            out[r.name] = str(e)
    failed = [r.name for r in routes if out.get(r.name)]
    if failed and (strict or any(r.primary for r in routes if r.name in failed)):
        raise RuntimeError(f"sinks failed: {failed}")
    return out


def compact(store: LogStore, mode: str = "physical", semantic: Callable[[], object] | None = None) -> dict[str, object]:
    """Compacts physically, semantically, or both, the meaning first; other modes are errors."""
    if mode not in ("physical", "semantic", "all"):
        raise ValueError(f"unknown compaction mode {mode!r}")
    out: dict[str, object] = {}
    if mode != "physical":
        if semantic is None:
            raise ValueError("semantic compaction needs a function")
        out["semantic"] = semantic()
    if mode != "semantic":
        out["physical"] = store.compact()
    return out
