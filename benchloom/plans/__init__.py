"""Named queries over the benchmark tables."""

from . import (  # noqa: F401  (imports register the queries)
    configs,
    features,
    gclogs,
    learning,
    results,
    sources,
)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
