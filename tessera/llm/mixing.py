"""Mixing sources to target weights.

Each document gets a hash-random key; within its source documents are ordered
by that key, and a distributed prefix sum of their token counts tells where
each document lies in its source. A source with target T and S tokens repeats
all its documents floor(T / S) times and takes the rest from the front of that
order, cut at exactly the token where the budget ends.

The prefix sum has two levels, so that a source with a third of all rows is
never one task's work: the key's leading bits cut every source into ``BUCKETS``
ranges of the key order; sums per (source, range) are combined map-side and
summed up over the ranges of a source (at most ``BUCKETS`` rows a source), and
rows are summed up only within their own range.

Sources that would need more than ``max_epochs`` passes get that many, and
what they leave is shared among the others by weight, until none is above
(water filling: in the order of limit per weight, a source is full if its
limit is below its share of what is left).

Only DataFrame functions are used. Defined results: a null or empty text has
size 0 and is never taken; a null source is a source of its own, last in
order; a null id is the empty text in the key; repeated rows count as rows of
their own; extra columns are dropped, so their names cannot clash; with no
tokens at all every target is 0; an empty table gives an empty result; a very
long text is one document, taken in part where the cut falls; rows of one key
are ordered by size and by the text's digest. Sources must be few: their totals
pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged, word_count

# Ranges of the key order within a source: the first three hex digits.
BUCKETS = 16**3


def cyclic_weight(position: Column, weights: tuple[int, ...]) -> Column:
    """Weight of the source at 0-based ``position``, repeating ``weights``."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(__source, source_size, target) from (__source, source, source_size).

    One row per source: the table of a mix's configuration, small by nature,
    so its three running sums are plain windows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.select(
        "__source",
        "source",
        "source_size",
        cyclic_weight(F.row_number().over(by_name) - 1, weights).alias("weight"),
    )
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    share = weighted.select(
        "*",
        (F.col("source_size") * max_epochs).alias("cap"),
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * max_epochs).over(upto), F.lit(0)).alias("full"),
        F.sum("weight").over(onward).alias("open_weight"),
        F.row_number().over(fill).alias("turn"),
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open_weight"))
    # the first source (in fill order) whose limit holds its share sets the level of all later ones
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    levelled = share.withColumn("first_fit", F.min(F.when(fits, F.col("turn"))).over(everything)).withColumn(
        "common", F.min(F.when(F.col("turn") == F.col("first_fit"), F.col("level"))).over(everything)
    )
    target = F.when(F.col("turn") >= F.col("first_fit"), F.col("common") * F.col("weight")).otherwise(
        F.col("cap").cast("double")
    )
    return levelled.select("__source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    size: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target,
    epochs (whole passes), part (further tokens from its front) and
    taken = epochs * size + part; ``keep`` names further columns to carry."""
    source = F.col("source")
    sized = staged(
        docs.select(
            "doc_id",
            "source",
            # a null source is a key of its own
            F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("__source"),
            (word_count(F.col("text")) if size is None else size).alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("__key"),
            F.md5(F.coalesce("text", F.lit(""))).alias("__tie"),
            *[F.col(c) for c in keep],
        ).withColumn("__bucket", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int")),
        "mix",
    )
    sums = sized.groupBy("__source", "__bucket").agg(F.sum("size").alias("__sum"), F.first("source").alias("source"))
    totals = source_targets(
        sums.groupBy("__source").agg(F.sum("__sum").alias("source_size"), F.first("source").alias("source")),
        weights,
        max_epochs,
    )
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "__source", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset")
    ).join(totals, "__source")
    within = Window.partitionBy("__source", "__bucket").orderBy("__key", "size", "__tie")
    summed = sized.withColumn(
        "__local",
        F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    placed = summed.join(offsets, ["__source", "__bucket"]).withColumn("__start", F.col("__offset") + F.col("__local"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("epochs", epochs.cast("long"))
    rest = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("__start"), F.lit(0)), F.col("size")).cast("long")
    return placed.withColumn("part", part).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "epochs",
        "part",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        *keep,
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of the mix, whole documents with all their columns: a document
    stands once per epoch, and once more if at least half of it lies before
    the cut of its source."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))
    mixed = mix(packed, weights, max_epochs, seed, keep=("__row",))
    copies = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    return (
        mixed.select("__row", copies.cast("int").alias("__copies"))
        .filter("__copies > 0")
        .select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
        .select("__row.*")
    )
