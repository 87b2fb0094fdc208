"""Small sides of joins, with their size checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.session import materialize

BROADCAST_ROWS = 200_000


def pin(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Run a summary once and keep it as a local relation when it holds at most ``max_rows`` rows.

    Returns the table and whether it is small. A summary above the bound is written to the shared folder instead, so
    what it was made from is not computed again either way.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return materialize(df, "summary"), False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` ready to be the small side of a join: broadcast when its row count is checked to be within
    ``max_rows``; beyond that unhinted, leaving a shuffle join with adaptive skew handling to Spark."""
    pinned, small = pin(df, max_rows)
    return F.broadcast(pinned) if small else pinned
