"""Queries over the ride tables and their SQL."""

from wayfold.plans import clusters, folds, network  # noqa: F401  (they register their queries)
from wayfold.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
