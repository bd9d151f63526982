"""Ranking without a single-task window.

``row_number() OVER (ORDER BY x)`` with no PARTITION BY runs in one task
(Spark plans a ``SinglePartition`` exchange), and ``PARTITION BY k`` puts a hot
key in one task. What is needed instead:

* RANK and PERCENT_RANK depend on how many rows come before a *value*. The
  values are counted (map-side combine), the histogram is put in order by
  ranges and summed up, and rows get their value's rank by an equi-join. Wide
  rows are neither sorted nor written.
* NTILE adds the order of rows within a value only where a tile's border cuts
  it: the ids at the borders are found by selection (``selection.values_at``).
* ROW_NUMBER alone needs all rows in order: ``repartitionByRange`` samples the
  sort key and splits the data into range partitions (a hot key is spread over
  several), a row's position in its partition is its offset in
  ``monotonically_increasing_id`` and per-partition counts (one row per
  partition) give the numbers before it. The ranged rows are written to the
  session's shared checkpoint folder: the branch that counts them and the
  branch that numbers them must see the very same partitions, and a lost
  executor re-reads files.

The plan is the same at every size; a hot value or group is one row of the
histogram, joined to many rows, which AQE's skew-join handling splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.selection import values_at
from tessera.operators.staging import materialise
from tessera.session import shuffle_partitions

_PID = "__pid"
_MID = "__mid"
_OFF = "__off"
_TOTAL = "__total"


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_row_number(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "row_number",
    total: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Append a 1-based row number over ``order`` across the whole DataFrame.

    ``order`` should be a total order when the numbering must be reproducible;
    with ties, rows that tie receive consecutive numbers in arbitrary order.
    ``total`` optionally names a column holding the row count of ``df``.
    """
    order = _cols(order)
    n = num_partitions or shuffle_partitions(df.sparkSession)
    # The range bounds come from a sample taken per exchange, so both branches
    # read the numbered rows from files.
    ranged = materialise(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id()),
        "ranged",
    )
    counts = ranged.groupBy(_PID).agg(F.count(F.lit(1)).alias("__cnt"))
    # One row per range partition: prefix sums in a single small task.
    offsets = counts.select(
        _PID,
        (F.sum("__cnt").over(Window.orderBy(_PID)) - F.col("__cnt")).alias(_OFF),
        F.sum("__cnt").over(Window.partitionBy()).alias(_TOTAL),
    )
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    out = ranged.join(F.broadcast(offsets), _PID).withColumn(name, local + F.col(_OFF) + 1)
    if total:
        out = out.withColumnRenamed(_TOTAL, total)
    return out.drop(_PID, _MID, _OFF, _TOTAL)


def join_group_values(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach per-group aggregates of ``df`` to each of its rows.

    The aggregation is partial (map-side combine), and the join back is an
    equi-join on null-safe keys, so a hot group never lands in one buffer.
    """
    keys = list(keys)
    renamed = [f"__gk{i}" for i in range(len(keys))]
    groups = df.groupBy(*keys).agg(*aggs)
    groups = groups.select(
        *[F.col(k).alias(r) for k, r in zip(keys, renamed)],
        *[c for c in groups.columns if c not in keys],
    )
    cond = [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed)]
    return df.join(groups, cond, "inner").drop(*renamed)


def ntile_expr(rn: Column, total: Column, tiles: int) -> Column:
    """NTILE bucket for 1-based position ``rn`` among ``total`` rows.

    The first ``total % tiles`` buckets hold one row more than the others.
    """
    q = F.floor(total / F.lit(tiles)).cast("long")
    r = total - q * F.lit(tiles)
    big = r * (q + 1)
    return (
        F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
        .otherwise(r + F.floor((rn - big - 1) / F.greatest(q, F.lit(1))) + 1)
        .cast("int")
    )


def value_ranks(
    df: DataFrame, partition_by: Sequence[str], value_order: Sequence[Column], value_cols: Sequence[str]
) -> DataFrame:
    """One row per (``partition_by``, ``value_cols``) of ``df``: ``__before``
    (rows of the partition that come before the value), ``__count`` (rows that
    have it) and ``__size`` (rows of the partition).

    Only the histogram - distinct values and their counts, made with a map-side
    combine - is put in order; it is written once, because the counts per range
    partition and the numbering must see the same partitions."""
    partition_by = list(partition_by)
    keys = [*partition_by, *value_cols]
    order = [F.col(c).asc_nulls_first() for c in partition_by] + list(value_order)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"))
    ranged = materialise(counted.repartitionByRange(*order).withColumn(_PID, F.spark_partition_id()), "histogram")
    totals = ranged.groupBy(_PID).agg(F.sum("__count").alias("__cnt"))
    # one row per range partition
    offsets = totals.select(
        _PID,
        (F.sum("__cnt").over(Window.orderBy(_PID)) - F.col("__cnt")).alias(_OFF),
        F.sum("__cnt").over(Window.partitionBy()).alias("__size"),
    )
    inside = Window.partitionBy(_PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("__before", F.coalesce(F.sum("__count").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), _PID)
        .withColumn("__before", F.col("__before") + F.col(_OFF))
        .drop(_PID, _OFF)
    )
    if not partition_by:
        return placed
    based = join_group_values(
        placed.drop("__size"), partition_by, F.min("__before").alias("__base"), F.sum("__count").alias("__size")
    )
    return based.withColumn("__before", F.col("__before") - F.col("__base")).drop("__base")


def join_null_safe(df: DataFrame, values: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` joined to ``values`` on equal columns, NULL equal to NULL; the
    columns stay once."""
    renamed = values.select(*[F.col(c).alias(f"__v_{c}") for c in on], *[c for c in values.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond &= F.col(c).eqNullSafe(F.col(f"__v_{c}"))
    return df.join(renamed, cond).drop(*[f"__v_{c}" for c in on])


def ntile_by_value(df: DataFrame, value: str, unique: str, tiles: int, name: str) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY value, unique)``, NULL values first.

    The histogram of ``value`` says in which tile the rows of a value begin and
    which of the ``tiles - 1`` borders cut it. Only for those few values the
    order by ``unique`` (not NULL, no two equal within a value) matters, and
    there only the ids at the borders are looked for, by selection."""
    values = value_ranks(df.select(value), [], [F.col(value).asc_nulls_first()], [value])
    n, first, count = F.col("__size"), F.col("__before"), F.col("__count")
    q, extra = F.floor(n / F.lit(tiles)), n % tiles
    ends = [q * i + F.least(F.lit(i), extra) for i in range(1, tiles)]  # rows up to tile i
    cuts = F.filter(F.array(*ends), lambda e: (e > first) & (e < first + count)) if ends else F.array().cast("array<long>")
    values = values.select(
        value, ntile_expr(first + 1, n, tiles).alias("__tile"), F.transform(cuts, lambda e: e - first - 1).alias("__cuts")
    )
    cut = values.filter(F.size("__cuts") > 0).select(F.col(value).alias("__value"), "__cuts")
    # at most tiles - 1 rows
    within = df.select(value, unique).join(F.broadcast(cut), F.col(value).eqNullSafe(F.col("__value")))
    ranks = [F.get(F.col("__cuts"), F.lit(i)) for i in range(tiles - 1)]
    spread = [i / 16 for i in range(17)]
    ids = values_at(within.drop("__value"), [value, "__cuts"], unique, spread, lambda _: ranks, accuracy=1_000) if ranks else None
    placed = join_null_safe(df, values.drop("__cuts"), [value])
    if ids is None:
        return placed.withColumnRenamed("__tile", name)
    last = ids.select(F.col(value).alias("__value"), F.col("at").alias("__last"))
    after = F.coalesce(F.size(F.filter("__last", lambda x: x < F.col(unique))), F.lit(0))
    out = placed.join(F.broadcast(last), F.col(value).eqNullSafe(F.col("__value")), "left")
    return out.select(*df.columns, (F.col("__tile") + F.when(F.col("__last").isNull(), 0).otherwise(after)).cast("int").alias(name))


def ranked(
    df: DataFrame,
    value_order: Sequence[Column],
    value_cols: Sequence[str],
    tiebreak: Sequence[Column | str] = (),
    partition_by: Sequence[str] = (),
    rank: str | None = None,
    percent_rank: str | None = None,
    row_number: str | None = None,
) -> DataFrame:
    """RANK / PERCENT_RANK / ROW_NUMBER over (``partition_by``, ``value_order``).

    ``value_cols`` are the columns behind ``value_order`` (ties are rows equal
    on them). Ranks come from the histogram of the values; only a row number
    needs the rows themselves in order, by ``tiebreak`` within a value. Without
    ``partition_by`` the ranking is over the whole DataFrame.
    """
    partition_by, keep = list(partition_by), list(df.columns)
    out, extra = df, []
    if rank or percent_rank:
        values = value_ranks(df, partition_by, value_order, value_cols)
        out = join_null_safe(out, values, [*partition_by, *value_cols])
        size, before = F.col("__size"), F.col("__before")
        if rank:
            extra.append((before + 1).cast("int").alias(rank))
        if percent_rank:
            extra.append(
                F.when(size <= 1, F.lit(0.0)).otherwise(before.cast("double") / (size - 1)).alias(percent_rank)
            )
        out = out.select(*keep, *extra)
    if row_number:
        order = [F.col(c).asc_nulls_first() for c in partition_by] + list(value_order) + _cols(tiebreak)
        out = global_row_number(out, order, name="__rn")
        if partition_by:
            out = join_group_values(out, partition_by, F.min("__rn").alias("__base"))
            out = out.withColumn("__rn", F.col("__rn") - F.col("__base") + 1).drop("__base")
        out = out.withColumnRenamed("__rn", row_number)
    return out
