"""Operators bound to the driver's tables: QUERIES by name, and the SQL they are held against."""

from edgeloom.plans import edge_queries, graph_queries, order_queries, quality_queries, source_queries  # noqa: F401  they register their queries
from edgeloom.plans.registry import QUERIES, SQL  # noqa: F401
