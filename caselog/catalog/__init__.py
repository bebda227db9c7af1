"""Named queries over the benchmark tables, each with the SQL that gives the same rows."""

from caselog.catalog import (  # noqa: F401
    binning,
    datasets,
    embedding,
    encoding,
    evaluation,
    prediction,
    scans,
    search,
    sequences,
)
from caselog.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
