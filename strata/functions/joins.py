"""Join helpers with an explicit size check before broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a statistics table that may be broadcast to every executor.
BROADCAST_ROW_LIMIT = 2_000_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               limit: int = BROADCAST_ROW_LIMIT, rows: int | None = None) -> DataFrame:
    """Join ``small`` onto ``big``, broadcasting it only when its row count is bounded.

    ``rows`` is the row count of ``small`` when the caller already knows it
    (from a statistics job it runs anyway); otherwise ``small`` (an already
    aggregated table) is counted.  Above the limit the join stays a shuffle
    join and AQE picks the strategy at runtime.
    """
    n = small.count() if rows is None else rows
    side = F.broadcast(small) if n <= limit else small
    return big.join(side, on, how)
