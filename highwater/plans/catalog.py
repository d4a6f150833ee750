"""All registered queries."""
from highwater.plans import learning, roads, serving, spatial  # noqa: F401
from highwater.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
