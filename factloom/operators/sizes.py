"""Broadcasts with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast; beyond it a join shuffles.
MAX_BROADCAST_ROWS = 100_000


def is_few(df: DataFrame) -> bool:
    return df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows are few."""
    return F.broadcast(df) if is_few(df) else df
