"""Imports every query module once and exposes the catalogue."""

from tidemark.operators import behaviour, budgets, derived, identity, kernels, novelty, patterns, raw, rules, served, sessions, signatures, sketches, store, urls  # noqa: F401
from tidemark.plans import flagship  # noqa: F401
from tidemark.streaming import live  # noqa: F401
from tidemark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
