"""All queries of the library by name, with their SQL."""

from harrow.plans import crop_queries, field_queries, planning_queries, queries, repair_queries, sequence_queries  # noqa: F401  # they register their queries
from harrow.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
