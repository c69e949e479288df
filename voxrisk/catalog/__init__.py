"""All registered queries."""

from voxrisk.catalog import comment_queries, model_queries, people_queries, report_queries, table_queries, text_queries
from voxrisk.catalog.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "comment_queries", "model_queries", "people_queries", "report_queries", "table_queries", "text_queries",
]
