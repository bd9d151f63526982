"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A text (A-Z lower-cased) is the multiset of its four-word shingles, space
joined; a text of fewer words is one shingle of all of them. Every shingle is
hashed (XXH64 of its UTF-8, seed 42) and a bit of the fingerprint is 1 if it is
set in over half of the hashes, repeats counted.

Two fingerprints link if at most ``DISTANCE`` = 4 bits differ. The 64 bits are
cut into ``BLOCKS`` = 8 blocks; four differing bits touch at most four of them,
so a close pair agrees on at least one of the 70 choices of four blocks
(32 bits). Fingerprints that agree on a choice share a bucket, and only those
are compared. Equal fingerprints are one fingerprint, whatever their number.

Classes are connected components, so a bucket need not list its pairs:

1. every member is compared with the bucket's smallest fingerprint, which is
   taken along by a map-side aggregation: one row a member;
2. components are formed of the links so far. Of two members of different
   components at least one is not of the smallest fingerprint's component:
   those strays are compared with all members, in blocks of at most about
   ``SLAB`` by ``SLAB`` fingerprints a task step, and of the links found
   between a block and a component one is kept.

After that every pair that shares a bucket was compared or is in one component
already. There is no cap. A bucket of n copies costs n comparisons; one of n
fingerprints that are all apart costs up to n * n cheap ones (one XOR and one
bit count each), spread over blocks and never written as rows.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero, which links like any other; repeated rows share a class; a
very long text is hashed piece by piece; a null id names a class only if all
its ids are null; an empty table gives an empty result; ties do not arise (the
smallest id names a class); other columns of ``docs`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.order_minhash import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCKS = 8
SLAB = 2048
PIECE = 1 << 16  # shingles counted at a time


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text; 0 without a word."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # ASCII letters only
    words = data.split()  # at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    m = max(len(words) - SHINGLE + 1, 1)
    starts = np.concatenate(([0], ends[: m - 1] + 1))
    ends = ends[min(SHINGLE, len(words)) - 1 :]
    of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, m, PIECE):
        cut = zip(starts[k : k + PIECE].tolist(), ends[k : k + PIECE].tolist())
        hashes = np.array([of(joined[a:b], SEED) for a, b in cut], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > m).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text, as a signed
    long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """The choices of blocks on which a close pair can agree, as signed masks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    made = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def _slab_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """(strays, members) -> links between members of different components,
    one for each stray and component."""
    for batch in batches:
        out = []
        for strays, members in zip(batch.column(0), batch.column(1)):
            s_fp, s_root, m_fp, m_root = (
                np.asarray(x.values.field(c)) for x in (strays, members) for c in ("fp", "root")
            )
            for fp, root in zip(s_fp, s_root):
                near = np.flatnonzero((np.bitwise_count((m_fp ^ fp).view(np.uint64)) <= distance) & (m_root != root))
                if len(near):
                    first = near[np.unique(m_root[near], return_index=True)[1]]
                    out.append(np.stack([np.full(len(first), fp), m_fp[first]]))
        a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, slab: int = SLAB) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (column fp) at most
    ``distance`` bits apart, enough of them to join all such pairs."""
    bits = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(distance, blocks)])
    keyed = fps.select("fp", F.posexplode(bits).alias("choice", "bits"))
    key = ["choice", "bits"]
    # buckets of one fingerprint, nearly all, end here
    hubs = keyed.groupBy(*key).agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = staged(keyed.join(hubs, key), "simhash-met")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= distance
    stars = staged(
        met.filter((F.col("fp") != F.col("hub")) & close).select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct(),
        "simhash-stars",
    )
    roots = components(stars, max_steps=1000).withColumnRenamed("tid", "fp")
    members = met.filter("size > 2").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    members = staged(members, "simhash-members")
    # a bucket whose members share one root is done
    open_ = members.groupBy(*key).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    slabs = F.ceil(F.col("size") / slab).cast("int")
    rest = members.join(open_.select(*key), key).select(
        *key, "fp", "root", (F.col("fp") == F.col("hub")).alias("is_hub"), slabs.alias("slabs"),
        F.pmod(F.xxhash64("fp"), slabs).cast("int").alias("slab"),
    )
    rest = staged(rest, "simhash-open")
    hub_roots = rest.filter("is_hub").select(*key, F.col("root").alias("hub_root"))
    one = F.struct("fp", "root")
    # bounded: about ``slab`` members of a bucket
    right = rest.groupBy(*key, "slab").agg(F.collect_list(one).alias("members"))
    left = (
        rest.join(hub_roots, key)
        .filter("root != hub_root")
        .groupBy(*key, F.col("slab").alias("s_slab"))
        .agg(F.first("slabs").alias("slabs"), F.collect_list(one).alias("strays"))
        .select(*key, F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"), "strays")
    )
    late = (
        left.join(right, [*key, "slab"])
        .select("strays", "members")
        .mapInArrow(lambda batches: _slab_links(batches, distance), "a long, b long")
    )
    return stars.unionByName(late.distinct())


def classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id (smallest
    id of the class) and class_size (rows)."""
    rows = staged(fingerprints(docs), "simhash-fps")
    fps = staged(
        rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct"
    )
    found = staged(links(fps.select("fp"), distance), "simhash-links")
    roots = components(found, max_steps=1000).withColumnRenamed("tid", "fp")
    placed = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("class_size"))
    of = placed.select("fp", "root").join(named, "root").select("fp", "component_id", "class_size")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id", "class_size")
