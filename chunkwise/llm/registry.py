"""What the query registry of the repository adds if this package is there."""

from chunkwise.llm.queries import QUERIES
from chunkwise.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
