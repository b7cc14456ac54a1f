"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from tessera.plans import bundle, cells, commits, documents, governance, lookups, pages, publishing, records, relational, retrieval, summaries, tables  # noqa: F401
from tessera.plans.base import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "ret13_rrf_fusion"
