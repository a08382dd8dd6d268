"""All registered queries. Importing the package fills the registry."""

from terravox.plans.registry import QUERIES, Query
from terravox.plans import decision_queries, field_queries, governance_queries, matching_queries, path_queries, profile_queries, relational_queries, root_queries, routing_queries, search_queries, spatial_queries, stat_queries, topology_queries  # noqa: F401

__all__ = ["QUERIES", "Query"]
