"""Ordered arrays of a key's rows, as pages of bounded size.

``ARRAY_AGG(STRUCT(...) ORDER BY t)`` per key is one value that grows with the
key: a busy user's history must fit into one row of one task. A page holds at
most ``page_size`` consecutive elements of that array; (key, page) orders the
pages, and their elements one after the other are the whole array. A key's
pages are built in different tasks.

``unnest`` reads pages as a relation again, one row per element, without a
shuffle. A page carries the first element of the next one (``next_item``), so
that "the next element" is known at a page's end too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.slices import SLICE_ROWS, position_by_slices

PAGE_SIZE = 1_000


def paged_arrays(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: Sequence[str],
    page_size: int = PAGE_SIZE,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per (keys, page): ``page`` from 0, ``first_position`` from 1,
    ``items`` (array of structs of ``position`` and ``columns``, in order) and
    ``next_item`` (the struct that follows, NULL at a key's end).

    ``order`` and ``bucket`` are as for ``lead_by_slices``. An empty table has
    no page; NULL keys are a key."""
    if page_size < 1:
        raise ValueError("page_size must be at least 1")
    numbered = position_by_slices(
        df.select(*dict.fromkeys([*keys, *order, *columns])), keys, order, bucket, "__position", slice_rows
    )
    place = F.col("__position")
    page = F.floor((place - 1) / page_size).cast("long")
    # the first element of a page also goes to the page before, as what follows
    also = (place % page_size == (1 % page_size)) & (place > 1)
    own = F.struct(page.alias("page"), F.lit(False).alias("next"))
    before = F.struct((page - 1).alias("page"), F.lit(True).alias("next"))
    sent = numbered.select(
        *keys,
        F.struct(place.alias("position"), *columns).alias("item"),
        F.explode(F.when(also, F.array(own, before)).otherwise(F.array(own))).alias("to"),
    )
    item = F.col("item")
    return sent.groupBy(*keys, F.col("to.page").alias("page")).agg(
        F.min("item.position").alias("first_position"),
        F.array_sort(F.collect_list(F.when(~F.col("to.next"), item))).alias("items"),
        F.max(F.when(F.col("to.next"), item)).alias("next_item"),
    )


def unnest(pages: DataFrame, keys: Sequence[str], columns: Mapping[str, str], following: Mapping[str, str]) -> DataFrame:
    """The pages' elements as rows: ``keys``, then ``columns`` (output name ->
    field of the element) and ``following`` (output name -> field of the next
    element of the key, NULL after its last)."""
    items = F.col("items")
    pairs = F.transform(
        items,
        lambda item, i: F.struct(
            item.alias("item"),
            F.when(i + 1 < F.size(items), F.get(items, i + 1)).otherwise(F.col("next_item")).alias("next"),
        ),
    )
    rows = pages.select(*keys, F.explode(pairs).alias("__e"))
    return rows.select(
        *keys,
        *[F.col(f"__e.item.{field}").alias(name) for name, field in columns.items()],
        *[F.col(f"__e.next.{field}").alias(name) for name, field in following.items()],
    )
