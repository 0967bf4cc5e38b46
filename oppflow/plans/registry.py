"""All queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

from . import contracts, corpus, ingestion, listing, snapshots

_PARTS = [listing, ingestion, corpus, contracts, snapshots]
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}
