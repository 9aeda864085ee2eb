"""The registered queries over the driver's tables."""

from . import clauses, fields, models, records, relations, scores, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "clauses", "fields", "models", "records", "relations", "scores", "texts"]
