"""All registered queries."""

from turnlab.plans.catalog import (  # noqa: F401
    building, evaluation, files, labelling, learning, relations, statistics, tabulation,
)
from turnlab.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
