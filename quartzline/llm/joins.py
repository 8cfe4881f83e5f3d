"""Joins with a side that is expected to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.session import rows

#: Up to so many rows of narrow tables are broadcast; beyond, the join shuffles and adaptive execution splits its hot keys.
BROADCAST_ROWS = 1_000_000


def near(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins small, a written table, by broadcast where its row count allows that; counted() saves the job that counts."""
    return df.join(F.broadcast(small) if rows(small) <= limit else small, on, how)
