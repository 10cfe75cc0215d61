"""All queries of the bound graph, by name, with their SQL equivalents."""

from meshline.plans import domain_queries, feed_queries, graph_queries, lookup_queries, relational  # noqa: F401  importing registers
from meshline.plans.binding import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
