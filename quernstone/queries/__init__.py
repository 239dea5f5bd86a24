"""The registered queries over the driver's tables, each with its SQL where SQL can say it."""

from . import analytics, evidence, indexes, ingestion, learning, lookup, more, relational, retrieval  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
