"""All registered queries."""

from noticegrid.workload import (  # noqa: F401
    directory_queries,
    health_queries,
    page_queries,
    people_queries,
    rule_queries,
    scan_queries,
)
from noticegrid.workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
