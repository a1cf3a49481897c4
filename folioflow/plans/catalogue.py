"""Every query of the engine by name, with the SQL that states it."""

from __future__ import annotations

from ..operators import blocks, chapters, corrections, decisions, defects, ingest, ledger, levels, lexical, matching, providers, relations, roles, vectors, versions
from ..streaming import events, production
from .registry import Query, Registry

FLAGSHIP = "spend_lines"

ALL = Registry()
for part in (ledger, blocks, chapters, lexical, defects, relations, levels, vectors, ingest, providers, roles, matching, versions, corrections, decisions, events, production):
    ALL.include(part.R)

QUERIES: dict[str, Query] = ALL.queries
ORACLES: dict[str, str] = ALL.oracles
ROWS: dict[str, str] = ALL.rows
