"""Continuous state over a stream of events: routing, status, lifecycle, idempotence.

There is no event-time window in these semantics: state follows the order of
arrival.  State stays for good unless an idle time is given, after which a key is forgotten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from strataq.functions.predicates import TRANSITIONS
from strataq.operators.governance import GOVERNED, govern
from strataq.sessions import checkpoint_folder
from strataq.sources.log_store import LogStore


def read_events(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def route(stream: Column, task: Column, kind: Column) -> Column:
    """The lane of a signal: its own stream, else its task, else its kind if that is a lane, else chat."""
    return F.coalesce(stream, F.concat(F.lit("task:"), task), F.when(kind.isin("task", "code", "research", "tool"), kind), F.lit("chat"))


def running_status(events: DataFrame) -> DataFrame:
    return events.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values("seq")


def _stateful(rows: DataFrame, key: str, step: Callable, out: str, state: str, mode: str, idle: str | None) -> DataFrame:
    """A fold with one value of state for each key; a key that gets nothing for ``idle`` is forgotten, if that is given."""
    milliseconds = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    names = [c.split()[0] for c in out.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now, made = step(k[0], held.get if held.exists else None, batches)
        held.update(now)
        if milliseconds is not None:
            held.setTimeoutDuration(milliseconds)
        yield made[names]

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, out, state, mode, timeout)


def lifecycle(moves: DataFrame, idle: str | None = None) -> DataFrame:
    """The state of each memory after every batch; illegal moves are skipped."""

    def step(key, held, batches):
        now = held[0] if held else None
        for to in _rows(batches)["state"]:
            if now is None or now == to or to in TRANSITIONS[now]:
                now = to
        return (now,), pd.DataFrame({"memory_id": [key], "state": [now]})

    return _stateful(moves, "memory_id", step, "memory_id long, state string", "state string", "update", idle)


def idempotent(rows: DataFrame, idle: str | None = None) -> DataFrame:
    """Rows whose digest differs from the last one of their key, whichever batch that came in."""

    def step(key, held, batches):
        new = _rows(batches)
        before = new["digest"].shift(1)
        before.iloc[0] = held[0] if held else None
        return (new["digest"].iloc[-1],), new[(new["digest"] != before) | before.isna()]

    return _stateful(rows, "dedupe_key", step, "dedupe_key string, seq long, digest string", "digest string", "append", idle)


def facts(events: DataFrame, idle: str | None = None) -> DataFrame:
    """What statements and states lead to for each fact, event by event; see governance.govern."""

    def step(key, held, batches):
        now, out = (tuple(held) if held and held[0] is not None else None), []
        for e in _rows(batches).to_dict("records"):
            now, made = govern(now, e)
            out += [(key, e["seq"], *m) for m in made]
        return now or (None, None, None), pd.DataFrame(out, columns=["fact_key", "seq", "memory_id", "value", "state", "reason"])

    return _stateful(events, "fact_key", step, GOVERNED, "memory_id string, value string, state string", "append", idle)


def lanes(events: DataFrame, idle: str | None = None) -> DataFrame:
    """Numbers each lane's events from 1, in order: one worker has a lane at a time."""

    def step(key, held, batches):
        n, new = (held[0] if held else 0), _rows(batches)
        return (n + len(new),), new.assign(place=range(n + 1, n + 1 + len(new)))

    return _stateful(events, "lane", step, "lane string, seq long, place long", "n long", "append", idle)


def write_through(rows: DataFrame, store: LogStore, folder: str, then: Callable[[DataFrame], None] = lambda rows: None):
    """Writes a stream of envelopes to the log, batch by batch, and only then has ``then`` derive what it will.

    A batch that is run again after a failure writes nothing twice, for equal rows of a
    key are written once.  Returns the started query; ``folder`` keeps its progress.
    """

    def put(batch: DataFrame, _: int) -> None:
        store.append(batch)
        then(batch)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", folder).trigger(availableNow=True).start()


def drain(df: DataFrame, mode: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Runs a stream over all there is now and returns its result: all rows, or the last one of each key if the mode is update.

    Each batch is written to a folder of its own in the shared folder, beside the stream's
    progress, so that nothing is held on the driver and a batch that is run again replaces itself.
    """
    spark = df.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/out").schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.filter(F.col("batch") == last).drop("batch")
    if mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("_r")).select(*keys, "_r.*")
        return rows.select(*df.columns)
    return rows.drop("batch")
