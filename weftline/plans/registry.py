"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import block_queries, decide_queries, text_queries

QUERIES = {**text_queries.QUERIES, **block_queries.QUERIES, **decide_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **block_queries.ORACLES, **decide_queries.ORACLES}
