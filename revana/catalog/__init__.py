"""The registered queries: each one a Spark function and, where SQL can say it,
the equivalent SQL over the same tables."""

from revana.catalog import ingest, models, sentiment, survey, terms, text, topics  # noqa: F401
from revana.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
