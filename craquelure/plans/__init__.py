"""Registered queries, each with its SQL counterpart where SQL can express it."""

from craquelure.plans.registry import oracles, queries

__all__ = ["oracles", "queries"]
