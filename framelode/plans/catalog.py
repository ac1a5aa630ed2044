"""Imports every module that registers queries."""

from . import box_queries, domain_queries, more_queries, registry, relational_queries, track_queries  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
