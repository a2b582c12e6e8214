"""Registered queries of the document engine, each with equivalent SQL where SQL can express it."""

from docweft.queries import corpus, knowledge, retrieval
from docweft.queries.base import ORACLE_SQL, QUERIES

FLAGSHIP = "fusion_rrf"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "corpus", "knowledge", "retrieval"]
