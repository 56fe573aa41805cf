"""The registered queries; importing this package fills the registry."""

from . import documents, logs, plans, policies, retrieval, sql_text, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "documents", "logs", "plans", "policies", "retrieval", "sql_text", "streams"]
