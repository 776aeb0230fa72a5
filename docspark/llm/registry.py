"""What ``__spark_entry__`` adds: the subpackage's queries and their SQL."""

from docspark.llm.queries import QUERIES
from docspark.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
