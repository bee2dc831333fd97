"""All queries: importing this module registers them."""

from __future__ import annotations

from tessera.plans import q_access, q_catalog, q_context, q_graph, q_ledger, q_search, q_stream, q_text  # noqa: F401
from tessera.plans.registry import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
