"""What a cue comes to, worked out once: keywords, names, vector; bound to one partition."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from strataq.operators.retrieval import cue_terms


@dataclass(frozen=True)
class QueryContext:
    text: str
    namespace: str
    scope: str | None = None
    vector: tuple[float, ...] | None = None
    keywords: tuple[str, ...] = field(init=False)
    entities: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        words = re.split(r"[^\w]+", self.text)
        object.__setattr__(self, "keywords", tuple(cue_terms(self.text, 3)))
        object.__setattr__(self, "entities", tuple(dict.fromkeys(w for w in words if len(w) >= 2 and w[0].isupper())))

    def ensure(self, namespace: str, scope: str | None) -> QueryContext:
        """This context, if it was made for this partition; that of another one is an error."""
        if (self.namespace, self.scope) != (namespace, scope):
            raise ValueError("this context belongs to another partition")
        return self


def scope_of(**dimensions: Any) -> str | None:
    """One opaque scope for what isolates memories, such as a tenant and a user; none without dimensions."""
    known = {k: v for k, v in sorted(dimensions.items()) if v is not None}
    return hashlib.sha256(json.dumps(known, sort_keys=True, default=str).encode()).hexdigest()[:32] if known else None


def until_error(steps: Iterable[Callable[[], Any]]) -> tuple[list[Any], Exception | None]:
    """The results of steps in order, up to the first that fails, and its error."""
    out: list[Any] = []
    for step in steps:
        try:
            out.append(step())
        except Exception as e:  # the caller decides what the failure means
            return out, e
    return out, None
