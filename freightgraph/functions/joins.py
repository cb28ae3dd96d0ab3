"""Joins with tables that are small as a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 1_000_000  # rows that may be broadcast


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has at most SMALL rows; what it meets then stays where it is, else both are shuffled."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
