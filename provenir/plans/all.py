"""Every query of the catalog engine."""

from provenir.plans import queries2, queries3  # noqa: F401  registers their queries
from provenir.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
