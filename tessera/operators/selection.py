"""Exact order statistics without a global sort.

To find the value at a rank, rows need not be sorted, only those near it:

1. a quantile sketch of each group (one aggregation, merged map-side) gives
   fences around the wanted fractions;
2. the fences cut the values into cells, and the rows of each cell are counted
   exactly, so the cell that holds the rank is known whatever the sketch's
   error is;
3. the values of that cell alone are counted by value and ordered.

With the sketch's usual error the last step sees about ``4 / accuracy`` of a
group's rows; a bad sketch makes it larger, never wrong. Nothing is written
and no wide row moves: the three passes read (group, value).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def fence_fractions(wanted: Sequence[float], accuracy: int) -> list[float]:
    """Fractions just beside each wanted one, then further and further off."""
    steps = [2.0 / accuracy * 32**k for k in range(4)]
    near = {min(max(q + sign * s, 0.0), 1.0) for q in wanted for s in steps for sign in (-1, 1)}
    return sorted(near)


def _on(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``left`` with the one row of its group in ``right``."""
    if not groups:
        packed = right.select(F.struct("*").alias("__one"))
        return left.withColumn("__one", packed.scalar()).select("*", "__one.*").drop("__one")
    renamed = right.select(*[F.col(g).alias(f"__o_{g}") for g in groups], *[c for c in right.columns if c not in groups])
    cond = F.lit(True)
    for g in groups:
        cond &= F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    return left.join(renamed, cond).drop(*[f"__o_{g}" for g in groups])


def values_at(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    fractions: Sequence[float],
    ranks: Callable[[Column], Sequence[Column]],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Per group of ``groups``: ``n`` (values that are not NULL) and ``at``, the
    values at the 0-based ``ranks(n)`` in ascending order. ``fractions`` say
    about where the ranks are. Groups without a value have no row."""
    groups = list(groups)
    v = F.col("__v")
    base = df.select(*groups, F.col(value).alias("__v")).filter(v.isNotNull())
    fences = fence_fractions(fractions, accuracy)
    sketch = base.groupBy(*groups).agg(
        F.percentile_approx("__v", F.lit(fences), F.lit(accuracy)).alias("__fences"), F.count(F.lit(1)).alias("n")
    )
    sketch = sketch.filter(F.col("n") > 0)
    cell = sum(((v > F.get(F.col("__fences"), F.lit(i))).cast("int") for i in range(len(fences))), F.lit(0))
    celled = _on(base, sketch, groups).select(*groups, "__v", "n", cell.alias("__cell"))
    counts = celled.groupBy(*groups, "__cell").agg(F.count(F.lit(1)).alias("__c"), F.first("n").alias("n"))
    # one row per group and cell: as many cells as fences, and one
    before = Window.partitionBy(*groups).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    wanted = placed.select(
        *groups,
        "__cell",
        "__before",
        "__c",
        "n",
        F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("n"))])).alias("__i", "__rank"),
    ).filter((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__c")))
    cells = wanted.groupBy(*groups).agg(
        F.collect_set("__cell").alias("__cells"),
        F.max("n").alias("n"),
        F.collect_list(F.struct("__cell", "__i", (F.col("__rank") - F.col("__before")).alias("__left"))).alias("__wanted"),
    )
    inside = _on(base, sketch.drop("n"), groups).select(*groups, "__v", cell.alias("__cell"))
    inside = _on(inside, cells, groups).filter(F.array_contains("__cells", F.col("__cell")))
    tally = inside.groupBy(*groups, "__cell", "__v").agg(
        F.count(F.lit(1)).alias("__c"), F.first("__wanted").alias("__wanted"), F.first("n").alias("n")
    )
    upto = Window.partitionBy(*groups, "__cell").orderBy("__v")
    tally = tally.withColumn("__upto", F.sum("__c").over(upto))
    hit = F.filter(
        "__wanted",
        lambda w: (w["__cell"] == F.col("__cell"))
        & (w["__left"] < F.col("__upto"))
        & (w["__left"] >= F.col("__upto") - F.col("__c")),
    )
    found = tally.select(*groups, "n", "__v", F.explode(hit).alias("__w"))
    return found.groupBy(*groups).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("__w.__i"), "__v"))), lambda x: x["__v"]).alias("at"),
    )


def percentile_cont(
    df: DataFrame, groups: Sequence[str], value: str, q: float, name: str, accuracy: int = ACCURACY
) -> DataFrame:
    """Exact ``PERCENTILE_CONT(value, q)`` per group (or of all rows): linear
    between the values at both sides of rank ``(n - 1) * q``."""
    exact = lambda n: (n - 1) * F.lit(q)
    found = values_at(df, groups, value, [q], lambda n: [F.floor(exact(n)), F.ceil(exact(n))], accuracy)
    low, high = (F.get("at", F.lit(i)).cast("double") for i in (0, 1))
    part = exact(F.col("n")) - F.floor(exact(F.col("n")))
    return found.select(*groups, (low + (high - low) * part).alias(name))
