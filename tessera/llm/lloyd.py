"""Centroid clustering: Lloyd's rounds with the dimensions dealt to shards.

Vectors become integers, floor(scale * x), so that every sum is exact and a
rerun gives the same bits. They are cut twice: into chunks of rows, and every
chunk into column blocks of ``WIDTH`` dimensions, one row each, written once.
A round is

1. every (chunk, block) row computes the partial squared distances to the
   block's slice of the centroids;
2. the rows of a chunk meet by shuffle, their partial distances are added and
   the nearest centroid is taken (ties: the smaller number); only labels and
   distances leave this step;
3. the labels go back to the (chunk, block) rows, which add up their columns
   by label, once per task and then per block; each block makes its own slice
   of the new centroids, floor(sum / count), empty clusters keeping theirs.

A task holds one chunk's block and one slice, never whole vectors and
centroids; the driver passes on only the slices (clusters * dimensions numbers,
a bound that does not grow with the rows). Lineage is cut at every round, as a
round reads the written blocks and the slices of the last one.

Defined results: vectors of another length, null vectors and those with null or
non-finite components take no part; integers are kept within +-2**27 (so that
a squared distance of 64 dimensions fits a long); with fewer vectors than
clusters there are as many clusters as vectors; no vector: no row. Repeated
rows each count. Of rows with one id the smaller vector seeds first; a null id
seeds as the empty text. There are no texts here; a very long vector has more
blocks. Other columns pass through ``cluster`` unread and are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

WIDTH = 16
_MOST = 1 << 27


@dataclass
class Clusters:
    """``labels``: (chunk, labels, distances) staged, arrays in binary;
    ``centroids``: (clusters, dimensions) integers."""

    ids: DataFrame
    labels: DataFrame
    centroids: np.ndarray

    def rows(self) -> DataFrame:
        """(vec_id, cluster, distance), one row per vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, label, distance in zip(*batch.columns):
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.values,
                            pa.array(np.frombuffer(label.as_py(), np.int32)),
                            pa.array(np.frombuffer(distance.as_py(), np.int64)),
                        ],
                        names=["vec_id", "cluster", "distance"],
                    )

        both = self.ids.join(self.labels, "chunk").select("ids", "label", "distance")
        kind = self.ids.schema["ids"].dataType.elementType.simpleString()
        return both.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")

    def digest(self, cluster: int) -> str:
        """sha256 of a centroid's integers, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.centroids[cluster].tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors that take part, as arrays of longs."""
    x = F.col("embedding")
    usable = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.select("vec_id", "embedding").filter((F.size(x) == dims) & usable)
    top = F.lit(float(_MOST))
    whole = F.transform(
        x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * F.lit(float(scale)), top), -top)).cast("long")
    )
    return kept.select("vec_id", whole.alias("x"))


def _blocks(whole: DataFrame, dims: int, width: int) -> DataFrame:
    """(chunk, block, ids, x): a chunk's columns of one block; its ids go with
    block 0 only."""
    kind = whole.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            ids, n = batch.column(0), len(batch)
            x = np.asarray(batch.column(1).flatten(), np.int32).reshape(n, dims)
            # the files are read later, so that a task run again changes nothing
            chunk = (TaskContext.get().partitionId() << 32) + number
            starts = range(0, dims, width)
            offsets = pa.array([0, n] + [n] * (len(starts) - 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * len(starts), pa.int64()),
                    pa.array(range(len(starts)), pa.int32()),
                    pa.ListArray.from_arrays(offsets, ids),
                    pa.array([x[:, a : a + width].tobytes() for a in starts], pa.binary()),
                ],
                names=["chunk", "block", "ids", "x"],
            )

    return whole.mapInArrow(run, f"chunk long, block int, ids array<{kind}>, x binary")


def _nearest(blocks: DataFrame, slices: list[np.ndarray]) -> DataFrame:
    """(chunk, label, distance) from partial distances added by chunk."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                centre = slices[block]
                x = np.frombuffer(data.as_py(), np.int32).reshape(-1, centre.shape[1]).astype(np.int64)
                apart = np.empty((len(x), len(centre)), np.int64)
                for j, c in enumerate(centre):
                    d = x - c
                    apart[:, j] = np.einsum("ij,ij->i", d, d)
                out.append(apart.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=["chunk", "partial"]
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py(), np.int64) for p in table.column("partial")).reshape(-1, len(slices[0]))
        label = total.argmin(axis=1)  # the first of equals
        distance = total[np.arange(len(total)), label]
        return pa.table(
            {
                "chunk": table.column("chunk").slice(0, 1),
                "label": pa.array([label.astype(np.int32).tobytes()], pa.binary()),
                "distance": pa.array([distance.tobytes()], pa.binary()),
            }
        )

    parts = blocks.select("chunk", "block", "x").mapInArrow(partial, "chunk long, partial binary")
    # a group is one chunk: as many rows as there are blocks
    return parts.groupBy("chunk").applyInArrow(add, "chunk long, label binary, distance binary")


def _updated(blocks: DataFrame, labels: DataFrame, slices: list[np.ndarray]) -> list[np.ndarray]:
    """The new slices: every block adds up its own columns by label."""
    k = len(slices[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, data, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                width = slices[block].shape[1]
                x = np.frombuffer(data.as_py(), np.int32).reshape(-1, width)
                of = np.frombuffer(label.as_py(), np.int32)
                total, count = sums.setdefault(block, [np.zeros((k, width), np.int64), np.zeros(k, np.int64)])
                np.add.at(total, of, x)
                count += np.bincount(of, minlength=k)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([t.tobytes() for t, _ in sums.values()], pa.binary()),
                pa.array([c.tobytes() for _, c in sums.values()], pa.binary()),
            ],
            names=["block", "total", "count"],
        )

    def update(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        total, count = (
            sum(np.frombuffer(p.as_py(), np.int64) for p in table.column(c)) for c in ("total", "count")
        )
        old = slices[block]
        new = np.where(count[:, None] > 0, total.reshape(old.shape) // np.maximum(count, 1)[:, None], old)
        return pa.table({"block": pa.array([block], pa.int32()), "slice": pa.array([new.tobytes()], pa.binary())})

    summed = blocks.join(labels, "chunk").select("block", "x", "label").mapInArrow(add, "block int, total binary, count binary")
    made = summed.groupBy("block").applyInArrow(update, "block int, slice binary").collect()  # clusters * dimensions numbers
    out = list(slices)
    for row in made:
        out[row.block] = np.frombuffer(row.slice, np.int64).reshape(slices[row.block].shape)
    return out


def seeds(whole: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors of the smallest hashes of ``salt`` and id, in hash order."""
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = whole.select(name.alias("name"), "x").orderBy("name", "x").limit(clusters)
    return np.array([r.x for r in first.collect()], np.int64)


def cluster(
    vectors: DataFrame,
    clusters: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    salt: str = "2:",
    width: int = WIDTH,
) -> Clusters | None:
    """Clusters of the rows (vec_id, embedding) of ``vectors`` after
    ``rounds`` rounds and a last assignment; None without a vector."""
    whole = integers(vectors, dims, scale)
    centre = seeds(whole, clusters, salt)
    if not len(centre):
        return None
    blocks = staged(_blocks(whole, dims, width), "lloyd-blocks")
    slices = [centre[:, a : a + width] for a in range(0, dims, width)]
    for _ in range(rounds):
        slices = _updated(blocks, _nearest(blocks, slices), slices)
    labels = staged(_nearest(blocks, slices), "lloyd-labels")
    return Clusters(blocks.filter("block = 0").select("chunk", "ids"), labels, np.concatenate(slices, axis=1))
