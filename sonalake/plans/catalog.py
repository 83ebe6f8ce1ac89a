"""Every query of the engine with its SQL."""

from . import evaluation, relational, reports, signals  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "mf_descriptors"
