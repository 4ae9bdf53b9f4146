"""All queries by name, and the SQL of those that SQL can express."""

from .queries import ORACLES, QUERIES
from . import areas, breaths, cached, kernels, stored  # noqa: F401  (register their queries)

__all__ = ["ORACLES", "QUERIES"]
