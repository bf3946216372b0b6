"""All queries of the core."""

from weftline.catalog import algorithms, quality, relational  # noqa: F401
from weftline.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
