"""All queries of this package and their SQL."""

from tallywatch.llm import chat_queries, filter_queries, index_queries, similarity_queries, token_queries  # noqa: F401
from tallywatch.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
