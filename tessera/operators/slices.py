"""LEAD and position within a key in one shuffle of the rows, hot keys included.

A built-in window sends a key to one task. That is right for ordinary keys and
wrong for one that holds a large part of the rows. Here only keys of more than
``slice_rows`` rows are cut, into slices along their order of about that many
rows; every other key is one slice. The window runs within (key, slice), and a
slice hands over to its neighbours what crosses the cut: the first row of the
next slice for LEAD, the number of rows before it for the position. That is
one narrow row per slice of a hot key, so at most rows / ``slice_rows`` of
them, whatever the number of keys.

Which keys are hot is counted first, from the key columns alone, with a
map-side combine. A bucket expression (the day of a purchase, say) that never
decreases along the order says where a key can be cut: a slice is a run of
whole buckets, so a single bucket is never cut. NULL keys are a key, NULL
buckets come first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1_000_000
# A table of slices is broadcast up to so many counted rows; a larger one is
# joined as Spark sees fit.
BROADCAST_ROWS = 100_000
_SLICE, _ROW = "__slice", "__row"


def join_counted(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on ``on``, NULL matching NULL; ``right`` is counted and broadcast
    if it is within the bound. The key columns stay once."""
    within = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    renamed = right.select(*[F.col(c).alias(f"__on_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond &= F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return left.join(F.broadcast(renamed) if within else renamed, cond, how).drop(*[f"__on_{c}" for c in on])


def slices_of(df: DataFrame, keys: Sequence[str], bucket: Column, slice_rows: int) -> DataFrame | None:
    """(keys, __bucket, __slice) of the hot keys; None if there are none."""
    keys = list(keys)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > slice_rows).drop("__n")
    if not hot.take(1):
        return None
    of_hot = join_counted(df.select(*keys, bucket.alias("__bucket")), hot, keys, "inner")
    sizes = of_hot.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col("__bucket").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return sizes.select(
        *keys,
        "__bucket",
        F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / slice_rows).alias(_SLICE),
    )


def lead_by_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    lead_cols: Mapping[str, str],
    position: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``LEAD(src) OVER (PARTITION BY keys ORDER BY order)`` columns
    (``lead_cols``: output name -> source) and optionally a 1-based
    ``ROW_NUMBER()`` named ``position``. ``order`` names ascending columns,
    NULLs first, that should be a total order within a key; ``bucket`` is an
    expression that never decreases along it."""
    keys = list(keys)
    by = [F.col(c).asc_nulls_first() for c in order]
    slices = slices_of(df, keys, bucket, slice_rows)
    if slices is None:
        whole = Window.partitionBy(*keys).orderBy(*by)
        place = [F.row_number().over(whole).cast("long").alias(position)] if position else []
        return df.select("*", *[F.lead(src).over(whole).alias(out) for out, src in lead_cols.items()], *place)
    rows = join_counted(df.withColumn("__bucket", bucket), slices, [*keys, "__bucket"], "left").drop("__bucket")
    cut = [*keys, _SLICE]
    # (not null, value) orders NULLs first in a struct as well
    first = F.struct(
        *[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order],
        F.struct(F.lit(1).alias("__any"), *[F.col(src).alias(out) for out, src in lead_cols.items()]).alias("head"),
    )
    heads = (
        rows.filter(F.col(_SLICE).isNotNull())
        .groupBy(*cut)
        .agg(F.min(first).alias("__first"), F.count(F.lit(1)).alias("__size"))
    )
    along = Window.partitionBy(*keys).orderBy(_SLICE)
    carried = heads.select(
        *cut,
        "__size",
        F.lead("__first.head").over(along).alias("__next"),
        F.coalesce(F.sum("__size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(*cut).orderBy(*by)
    numbered = rows.select(
        "*",
        F.row_number().over(inside).alias(_ROW),
        *[F.lead(src).over(inside).alias(f"__lead_{out}") for out, src in lead_cols.items()],
    )
    joined = join_counted(numbered, carried, cut, "left")
    last = F.col(_ROW) == F.col("__size")  # NULL, so false, in a key of one slice
    leads = [F.when(last, F.col("__next")[out]).otherwise(F.col(f"__lead_{out}")).alias(out) for out in lead_cols]
    place = [(F.coalesce("__before", F.lit(0)) + F.col(_ROW)).cast("long").alias(position)] if position else []
    return joined.select(*df.columns, *leads, *place)


def position_by_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)``, hot keys cut."""
    return lead_by_slices(df, keys, order, bucket, {}, position=name, slice_rows=slice_rows)
