"""Filter by an uncorrelated scalar subquery (``WHERE c = (SELECT v FROM t2)``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scalar_subquery_filter(df: DataFrame, column: str, value_df: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` equals the single value of ``value_df``.

    ``value_df`` must have one column. As in SQL, no row makes the value NULL
    (nothing matches) and more than one row is an error at run time
    (``SCALAR_SUBQUERY_TOO_MANY_ROWS``). The subquery runs once and its value
    is used as a constant by the scan-side filter.
    """
    if len(value_df.columns) != 1:
        raise ValueError("value_df must have exactly one column")
    return df.where(F.col(column) == value_df.scalar())
