"""Joins with the settings' tables, broadcast where their size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 200_000
UNKNOWN = 1 << 60


def small(dim: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its plan bounds it by BROADCAST_BYTES, as it does for the settings' local tables.

    Where a plan has no bound at all, at most BROADCAST_ROWS + 1 rows are counted; beyond, Spark plans the join by itself."""
    size = int(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > BROADCAST_BYTES and (size < UNKNOWN or dim.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS):
        return dim
    return F.broadcast(dim)
