"""Broadcasts only of tables counted to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast; larger ones are shuffled.
ROWS = 200_000


def sized_broadcast(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df``, with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
