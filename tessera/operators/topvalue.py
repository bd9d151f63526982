"""Most frequent value per group (exact, deterministic).

Stands in for an approximate top-count aggregate: counts per (group, value)
are combined map-side, then the winner per group is a ``min`` over a struct
(``-count``, ``value is null``, ``value``) - again partial-aggregated - so a
hot group or a hot value never gathers in one buffer.

Ties go to the lowest value; NULL counts as a value and loses ties.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.distinct import stack


def top_values(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column | str],
    count_nulls: bool = True,
    distinct: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """One row per group of ``keys`` with the mode of each entry of ``values``
    and the number of distinct non-NULL values of each entry of ``distinct``.

    All value columns are stacked, each in a column of its own type, so that a
    single pair of aggregations serves all of them.
    """
    keys, distinct = list(keys), distinct or {}
    names = [*values, *distinct]
    exprs = [F.col(v) if isinstance(v, str) else v for v in [*values.values(), *distinct.values()]]
    stacked = df.select(*keys, F.explode(stack(exprs, df)).alias("__kv")).select(*keys, "__kv.*")
    if not count_nulls:
        stacked = stacked.filter(" OR ".join(f"__v{i} IS NOT NULL" for i in range(len(names))))
    cells = [f"__v{i}" for i in range(len(names))]
    counts = stacked.groupBy(*keys, "__k", *cells).agg(F.count(F.lit(1)).alias("__c"))

    def mode(i: int) -> Column:
        v = F.col(f"__v{i}")
        return F.min(F.when(F.col("__k") == i, F.struct((-F.col("__c")).alias("c"), v.isNull().alias("n"), v.alias("v"))))

    winners = counts.groupBy(*keys).agg(
        *[mode(i).alias(f"__b{i}") for i in range(len(values))],
        *[F.count(f"__v{len(values) + j}").alias(n) for j, n in enumerate(distinct)],
    )
    return winners.select(*keys, *[F.col(f"__b{i}.v").alias(n) for i, n in enumerate(values)], *distinct)
