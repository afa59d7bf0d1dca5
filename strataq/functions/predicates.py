"""Filters: partitions, time, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lifecycle states, the moves between them, and ranking boosts.
STATES = ("candidate", "short_term", "promoted", "pinned", "stale", "contradicted", "forgotten")
TRANSITIONS = {
    "candidate": ("short_term", "promoted", "pinned", "stale", "contradicted", "forgotten"),
    "short_term": ("promoted", "pinned", "stale", "contradicted", "forgotten"),
    "promoted": ("pinned", "stale", "contradicted", "forgotten"),
    "pinned": ("forgotten",),
    "stale": ("promoted", "pinned", "contradicted", "forgotten"),
    "contradicted": ("forgotten",),
    "forgotten": (),
}
BOOSTS = {"pinned": 5.0, "promoted": 2.0, "short_term": 0.5, "stale": -2.0}


def in_partition(namespace: str, scope: str | None) -> Column:
    """Namespace equal, scope null-safe equal: a null scope is a partition of its own."""
    return (F.col("namespace") == namespace) & F.col("scope").eqNullSafe(F.lit(scope))


def in_time(column: Column, after=None, before=None) -> Column:
    """Inclusive bounds; a null time fails a bound."""
    out = F.lit(True)
    if after is not None:
        out = out & (column >= F.lit(after))
    if before is not None:
        out = out & (column <= F.lit(before))
    return F.coalesce(out, F.lit(False))


def valid_at(start: Column, end: Column, at) -> Column:
    """A null bound is open."""
    return (start.isNull() | (start <= F.lit(at))) & (end.isNull() | (end >= F.lit(at)))


def visible(state: Column) -> Column:
    return ~F.coalesce(state, F.lit("")).isin("contradicted", "forgotten")


def consolidatable(state: Column) -> Column:
    return state.isNull() | state.isin("candidate", "short_term", "stale")


def boost(state: Column) -> Column:
    out = F.lit(0.0)
    for k, v in BOOSTS.items():
        out = F.when(state == k, F.lit(v)).otherwise(out)
    return out


def goes(current: Column, to: Column) -> Column:
    """Whether a memory in a state (null: none yet) may be written with the next one."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]) if v else F.array().cast("array<string>"))])
    return current.isNull() | (current == to) | F.coalesce(F.array_contains(table[current], to), F.lit(False))
