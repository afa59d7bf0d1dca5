"""Imports every module of queries, which fills the registry."""

from strataq.plans import derived_queries, knowledge_queries, memory_queries, text_queries  # noqa: F401
from strataq.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
