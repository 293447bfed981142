"""Registered queries of the library and their SQL."""

from . import audit_queries, log_queries  # register their queries
from .queries import ENTRY, ORACLE_SQL, QUERIES

__all__ = ["ENTRY", "ORACLE_SQL", "QUERIES", "audit_queries", "log_queries"]
