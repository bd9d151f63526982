"""Several COUNT(DISTINCT ...) over one grouping, without copying every row.

Two shapes: ``distinct_counts`` for distinct arguments on different columns,
``distinct_counts_of`` for counts over one column that differ by a condition.

Spark evaluates ``count(distinct a), count(distinct b)`` in one aggregation
by expanding each input row once per distinct argument, each copy carrying
all aggregated columns. Here the distinct arguments alone are stacked into
(group, argument index, value) rows, deduplicated - combined map-side, so a
hot group shrinks before the shuffle - and counted per group. NULL values are
not counted, as with COUNT(DISTINCT). Each argument keeps its type: the stack
has one column per argument, all but one of them NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(exprs: Sequence[Column], df: DataFrame) -> Column:
    """An array with one struct (__k, __v0, __v1, ...) per expression: its index and
    its value in its own column, NULL in the others'."""
    types = [f.dataType for f in df.select(*[e.alias(f"__v{i}") for i, e in enumerate(exprs)]).schema.fields]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("__k"),
                *[(e if j == i else F.lit(None)).cast(t).alias(f"__v{j}") for j, t in enumerate(types)],
            )
            for i, e in enumerate(exprs)
        ]
    )


def distinct_counts(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str]) -> DataFrame:
    """One row per group of ``keys`` with ``count(distinct value)`` for each
    entry of ``values`` (output name -> column or expression)."""
    keys = list(keys)
    names = list(values)
    exprs = [F.col(v) if isinstance(v, str) else v for v in values.values()]
    values_ = [f"__v{i}" for i in range(len(names))]
    stacked = (
        df.select(*keys, F.explode(stack(exprs, df)).alias("__kv"))
        .select(*keys, "__kv.*")
        .filter(" OR ".join(f"{v} IS NOT NULL" for v in values_))
        .distinct()
    )
    return stacked.groupBy(*keys).agg(
        *[F.count(f"__v{i}").alias(n) for i, n in enumerate(names)]
    )


def with_distinct_counts(
    groups: DataFrame, df: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str]
) -> DataFrame:
    """``groups`` (one row per group of ``keys``, e.g. the other aggregates
    of the same grouping) with the distinct counts of ``df`` attached; a
    group whose values are all NULL counts 0. Keys match NULL to NULL."""
    keys = list(keys)
    counts = distinct_counts(df, keys, values)
    renamed = counts.select(*[F.col(k).alias(f"__d_{k}") for k in keys], *values)
    cond = [F.col(k).eqNullSafe(F.col(f"__d_{k}")) for k in keys]
    joined = groups.join(renamed, cond, "left").drop(*[f"__d_{k}" for k in keys])
    return joined.select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in values else F.col(c) for c in joined.columns]
    )


def distinct_counts_of(
    df: DataFrame, keys: Sequence[str], column: str, counts: Mapping[str, Column | None]
) -> DataFrame:
    """Several COUNT(DISTINCT column) per group that differ only by a row
    condition (``None`` = all rows), e.g. customers, customers on mobile,
    customers on desktop: rows are reduced once to distinct (group, column),
    remembering for each condition whether any row met it, then counted."""
    keys = list(keys)
    conds = {n: c for n, c in counts.items() if c is not None}
    flags = [F.max(F.when(c, F.lit(1))).alias(f"__f_{n}") for n, c in conds.items()]
    per_value = (
        df.groupBy(*keys, column).agg(*flags) if flags else df.select(*keys, column).distinct()
    ).filter(F.col(column).isNotNull())
    return per_value.groupBy(*keys).agg(
        *[
            (F.count(F.lit(1)) if c is None else F.count(F.col(f"__f_{n}"))).alias(n)
            for n, c in counts.items()
        ]
    )
