"""Ordered sequences within a key (LEAD, position) that survive a hot key.

``LEAD(x) OVER (PARTITION BY user ORDER BY t)`` sends each user to one task;
a user holding a third of the rows would make that task a third of the job.
Here a key is cut into buckets that follow the order (the day of a purchase,
say): the built-in window runs within (key, bucket), and a narrow table with
one row per (key, bucket) - its size and its first row - says where a bucket
starts in its key and which row follows its last. One plan at every size: the
rows are shuffled once, by (key, bucket), and a key's buckets, not its rows,
meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_keys(keys: Sequence[str]) -> dict[str, Column]:
    """One non-null text column per key, so that equality joins and windows
    treat NULL as a value and share one partitioning."""
    return {
        f"__k{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for i, k in enumerate(keys)
    }


def lead_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    lead_cols: Mapping[str, str],
    position: str | None = None,
) -> DataFrame:
    """Add ``LEAD(src) OVER (PARTITION BY keys ORDER BY order)`` columns.

    ``lead_cols`` maps output name -> source column; ``order`` names ascending
    columns that should be a total order within each key. ``bucket`` is an
    integer expression that never decreases along that order; NULLs come first
    in both. ``position`` optionally names a 1-based ``ROW_NUMBER()`` in the
    key.
    """
    group = list(null_safe_keys(keys))
    cut = [*group, "__bucket"]
    lowest = F.lit(-(2**63)).cast("long")
    rows = df.withColumns({**null_safe_keys(keys), "__bucket": F.coalesce(bucket.cast("long"), lowest)})
    head = F.struct(*[F.col(src).alias(out) for out, src in lead_cols.items()], F.lit(1).alias("__any"))
    # NULLs first, as in the window
    first = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order], head.alias("head"))
    heads = rows.groupBy(*cut).agg(F.min(first).alias("__first"), F.count(F.lit(1)).alias("__size"))
    along = Window.partitionBy(*group).orderBy("__bucket")
    heads = heads.select(
        *cut,
        "__size",
        F.lead("__first.head").over(along).alias("__next"),
        F.coalesce(F.sum("__size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(*cut).orderBy(*[F.col(c).asc() for c in order])
    numbered = rows.select(
        "*",
        F.row_number().over(inside).alias("__row"),
        *[F.lead(src).over(inside).alias(f"__lead_{out}") for out, src in lead_cols.items()],
    )
    joined = numbered.join(heads, cut)
    last = F.col("__row") == F.col("__size")
    leads = [
        F.when(last, F.col("__next")[out]).otherwise(F.col(f"__lead_{out}")).alias(out) for out in lead_cols
    ]
    place = [(F.col("__before") + F.col("__row")).cast("long").alias(position)] if position else []
    return joined.select(*df.columns, *leads, *place)


def position_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)``, by buckets."""
    return lead_within(df, keys, order, bucket, {}, position=name)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str, sums: Mapping[str, Column]
) -> DataFrame:
    """For each row the sums of ``sums`` over the rows strictly before it in
    its key, by ``order``; ``bucket`` names a non-null column that never
    decreases along it. Keys must not be null."""
    cut = [*keys, bucket]
    weighted = df.select("*", *[c.alias(f"__w_{n}") for n, c in sums.items()])
    totals = weighted.groupBy(*cut).agg(*[F.sum(f"__w_{n}").alias(f"__t_{n}") for n in sums])
    along = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *cut, *[F.coalesce(F.sum(f"__t_{n}").over(along), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = weighted.select(
        "*", *[F.coalesce(F.sum(f"__w_{n}").over(inside), F.lit(0)).alias(f"__s_{n}") for n in sums]
    )
    return summed.join(offsets, cut).select(
        *df.columns, *[(F.col(f"__o_{n}") + F.col(f"__s_{n}")).alias(n) for n in sums]
    )
