"""Times of memories: normalising, defaults, where they are found, filters."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from strataq.functions import predicates as P

# The times that a memory may have.
FIELDS = ("occurred_at", "observed_at", "last_verified_at", "valid_from", "valid_until")
#: ISO 8601 with an offset; without one, a text is no time.
WITH_OFFSET = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})\s*$"


def normal(value: Column) -> Column:
    """A text as a time: it must carry an offset, else it is null."""
    return F.when(value.rlike(WITH_OFFSET), F.try_to_timestamp(F.trim(value)))


def moment_of(value: Any) -> dt.datetime | None:
    """A driver value as a time: naive ones count as UTC, a day as its midnight, a text must carry an offset; all else is none."""
    if isinstance(value, dt.datetime):
        return value if value.tzinfo else value.replace(tzinfo=dt.UTC)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day, tzinfo=dt.UTC)
    if isinstance(value, str):
        try:
            out = dt.datetime.fromisoformat(value)
        except ValueError:
            return None
        return out if out.tzinfo else None
    return None


def defaults(options: dict[str, Any], now: dt.datetime) -> dict[str, str | None]:
    """The five times of a new memory as ISO texts; it was observed now, unless told otherwise."""
    found = {f: moment_of(options.get(f)) for f in FIELDS}
    found["observed_at"] = found["observed_at"] or now
    return {f: None if v is None else v.astimezone(dt.UTC).isoformat() for f, v in found.items()}


def found_in(payload: Column) -> dict[str, Column]:
    """Each time from a JSON payload: its own field, else its metadata's, else its provenance's."""
    at = lambda path: normal(F.get_json_object(payload, path))
    return {f: F.coalesce(at(f"$.{f}"), at(f"$.metadata.{f}"), at(f"$.metadata.provenance.{f}")) for f in FIELDS}


def matches(filters: dict[str, Any]) -> Column:
    """Occurred and observed bounds (inclusive; a missing time fails one) and validity at a time; a bound that is no time is ignored."""
    out = F.lit(True)
    for field in ("occurred", "observed"):
        after, before = moment_of(filters.get(f"{field}_after")), moment_of(filters.get(f"{field}_before"))
        out = out & P.in_time(F.col(f"{field}_at"), after, before)
    at = moment_of(filters.get("valid_at"))
    return out if at is None else out & P.valid_at(F.col("valid_from"), F.col("valid_until"), at)


def rolled_up(rows: DataFrame, by: list[str], now: Column) -> DataFrame:
    """The times of what many rows support: the earliest occurrence and start, the latest observation, verification and end; observed now if never."""
    return rows.groupBy(*by).agg(
        F.min("occurred_at").alias("occurred_at"), F.coalesce(F.max("observed_at"), F.first(now)).alias("observed_at"), F.max("last_verified_at").alias("last_verified_at"),
        F.min("valid_from").alias("valid_from"), F.max("valid_until").alias("valid_until"),
    )


def cutoff(now: dt.datetime, milliseconds: int) -> dt.datetime:
    if not isinstance(milliseconds, int) or isinstance(milliseconds, bool) or milliseconds < 0:
        raise ValueError("milliseconds are a number from 0")
    return now - dt.timedelta(milliseconds=milliseconds)


def order_key(time: Column) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(time)
