"""Registered queries over the test tables, and their oracles."""

from __future__ import annotations

from freightgraph.plans import access, feeds, geometry, tables, upkeep  # noqa: F401

FLAGSHIP = "r12_compute_routes"
QUERIES = tables.QUERIES
ORACLES = {name: tables.with_views(sql) for name, sql in tables.ORACLES.items()}
