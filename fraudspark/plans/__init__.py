"""Named queries over the given tables, each with the SQL it is checked against."""

from fraudspark.plans import cases, contacts, insight, payments, streams, watch  # noqa: F401
from fraudspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
