"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import archive, content, desk, extraction, finding, folders, intake, ledger, recurring, review, sheets, similar, streams, twins
from .book import ORACLE_SQL, QUERIES

FLAGSHIP = "search_bm25"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "archive", "content", "desk", "extraction", "finding", "folders", "intake", "ledger", "recurring", "review", "sheets", "similar", "streams", "twins"]
