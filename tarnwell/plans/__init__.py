"""Registered queries of the retrieval engine."""

from . import event_queries, retrieval_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
