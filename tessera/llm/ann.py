"""Approximate nearest neighbours by largest inner product: inverted lists
scanned with adaptive dimensions.

Index. Centroids and a random rotation are fitted on at most ``max_fit``
vectors, chosen by a hash of the id; every vector is then filed under its
nearest centroid, in rotated form. Rotation spreads a vector's information
evenly over the dimensions, so a partial inner product over the first d of D
dimensions estimates the whole.

Search. A query probes the ``probe`` share of lists with the nearest
centroids. Lists are cut into blocks of about ``BLOCK`` vectors and the
queries of a list into blocks of their own, and every pair of blocks is one
group, so neither a hot list (a very common vector) nor a popular one is a
task of its own. Within a group the dimensions are scanned in column blocks:
after each, a candidate is abandoned if, were its inner product as large as
the query's current k-th best, a partial product this small would be ``Z``
standard deviations away. A bounded set of vectors (the fitting sample) gives
each query its first k-th best, so that scans prune from the start and emit
few rows: the threshold is the 2k-th best of those in the query's probed
lists, so that at least k of them are found there even if some are abandoned.
What survives is scored exactly on the original vectors, in double precision,
and the k best of all groups are the result. A query probes further lists
while those it has hold fewer than k others. The test may abandon too much, as
equal vectors are abandoned together: a query left with fewer than k rows is
searched again, in all lists and without abandoning.

Defined results: null or zero vectors, vectors holding null or non-finite
components, and vectors that have not the most common number of dimensions
take no part; a query never meets rows of its own id; a repeated row is scanned
once and is an answer as often as it occurs (of several vectors under one id
all are candidates, and the smallest is the query); ties go to the smaller id;
columns other than the id and the
vector are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

BLOCK = 4096
QUERY_BLOCK = 1024
COLUMNS = 16
Z = 3.0


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, copies): distinct valid vectors of the most common
    dimension, as doubles, and how often the row occurs."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite_and_some(F.col(embedding), finite)
    )
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return (
        rows.filter(F.size("v") == (common["n"] if common else 0)).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    )


def finite_and_some(v: Column, finite: Column) -> Column:
    return finite & F.exists(v, lambda x: x != 0)


@dataclass
class Index:
    """Rotation, centroids (rotated) and the fitting sample (ids, original
    vectors)."""

    rotation: np.ndarray
    centroids: np.ndarray
    ids: np.ndarray
    sample: np.ndarray


def fit(vectors: DataFrame, max_fit: int = 10_000, max_lists: int = 4096, steps: int = 12, seed: int = 5) -> Index | None:
    """Index from at most ``max_fit`` vectors; lists grow with the square root
    of all vectors, up to ``max_lists``."""
    total = vectors.count()
    if not total:
        return None
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max_fit).toArrow()
    ids = np.asarray(got.column(0))
    x = np.asarray(got.column(1).combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    turned = x @ rotation
    lists = int(min(max_lists, max(1, np.sqrt(total) / 4), max(1, len(ids) // 8)))
    centroids = turned[rng.choice(len(ids), lists, replace=False)].copy()
    for _ in range(steps):
        near = nearest(turned, centroids)[:, 0]
        size = np.bincount(near, minlength=lists)
        total_of = np.stack([np.bincount(near, weights=turned[:, d], minlength=lists) for d in range(x.shape[1])], 1)
        centroids = np.where(size[:, None] > 0, total_of / np.maximum(size, 1)[:, None], centroids)
    return Index(rotation, centroids, ids, x)


def nearest(x: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the ``n`` nearest centroids of each row, nearest first."""
    score = x @ centroids.T - 0.5 * (centroids**2).sum(1)
    if n == 1:
        return score.argmax(1)[:, None]
    return np.argsort(-score, axis=1, kind="stable")[:, :n]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows; a pair's value does not depend on what
    else is computed with it, so equal vectors tie exactly."""
    return np.multiply(q, x).sum(axis=1)


def scan(
    qid: np.ndarray, q: np.ndarray, tau: np.ndarray, xid: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, z: float = Z
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score): for each query the k best vectors of
    the group with a score of at least its ``tau``, by adaptive dimensions."""
    dims = q.shape[1]
    qr, xr = q @ rotation, x @ rotation
    qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    tau = tau.copy()
    best: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0)] for _ in qid]
    for begin in range(0, len(xid), 512):
        cols = slice(begin, begin + 512)
        for first in range(0, len(qid), 256):
            rows = slice(first, first + 256)
            partial = qr[rows, :COLUMNS] @ xr[cols, :COLUMNS].T
            scale = np.outer(qn[rows], xn[cols])
            qi, xi = np.nonzero(~_hopeless(partial, tau[rows, None], scale, min(COLUMNS, dims), dims, z))
            part, size = partial[qi, xi], scale[qi, xi]
            qi, xi = qi + first, xi + begin
            for d in range(COLUMNS, dims, COLUMNS):
                more = slice(d, min(d + COLUMNS, dims))
                part = part + np.einsum("ij,ij->i", qr[qi, more], xr[xi, more])
                stay = ~_hopeless(part, tau[qi], size, more.stop, dims, z)
                qi, xi, part, size = qi[stay], xi[stay], part[stay], size[stay]
            other = qid[qi] != xid[xi]
            qi, xi = qi[other], xi[other]
            score = exact(q[qi], x[xi])
            stay = score >= tau[qi]
            qi, xi, score = qi[stay], xi[stay], score[stay]
            for row in np.unique(qi):
                mine = qi == row
                at = np.concatenate([best[row][0], xi[mine]])
                s = np.concatenate([best[row][1], score[mine]])
                order = np.lexsort((xid[at], -s))[:k]
                best[row] = [at[order], s[order]]
                if len(order) == k:
                    tau[row] = max(tau[row], s[order][-1])
    sizes = [len(b[0]) for b in best]
    return (
        np.repeat(np.arange(len(qid)), sizes),
        np.concatenate([b[0] for b in best]) if best else np.zeros(0, np.int64),
        np.concatenate([b[1] for b in best]) if best else np.zeros(0),
    )


def _hopeless(partial, tau, scale, d: int, dims: int, z: float):
    """Whether a product of ``tau`` would, under a random rotation, hardly
    have so small a part in the first ``d`` of ``dims`` dimensions."""
    if d >= dims:
        return partial < tau - 1e-9 * scale
    cosine = np.clip(np.divide(tau, scale, out=np.zeros(np.broadcast(tau, scale).shape), where=(scale > 0) & np.isfinite(tau)), -1, 1)
    spread = np.sqrt((1 + cosine**2) * d * (dims - d) / (dims * dims * max(1, dims - 1)))
    return partial < tau * (d / dims) - z * scale * spread


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def search(
    base: DataFrame,
    queries: DataFrame,
    k: int = 20,
    probe: float = 0.75,
    max_fit: int = 10_000,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest found."""
    spark = base.sparkSession
    vectors = staged(usable(base, vec_id, embedding), "ann-vectors")
    index = fit(vectors, max_fit)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(index)
    lists = len(index.centroids)
    probes = max(1, int(np.ceil(probe * lists)))

    def file_under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            if batch.num_rows:
                near = nearest(_matrix(batch.column(1)) @ known.rotation, known.centroids)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], names=[*batch.schema.names, "list"])

    filed = staged(vectors.mapInArrow(file_under, "vec_id long, v array<double>, copies long, list long"), "ann-lists")
    asked = usable(queries, vec_id, embedding).filter(F.size("v") == index.rotation.shape[0])
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))

    # one number per list; there are at most max_lists
    vectors_of = {r["list"]: r["n"] for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}

    def probe_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        size = np.array([vectors_of.get(i, 0) for i in range(lists)])
        widest = np.linalg.norm(known.sample, axis=1).max()
        filed_sample = nearest(known.sample @ known.rotation, known.centroids)[:, 0]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q, ids = _matrix(batch.column(1)), np.asarray(batch.column(0))
                near = nearest(q @ known.rotation, known.centroids, lists).reshape(len(q), lists)
                held = np.cumsum(size[near], axis=1)
                enough = 1 + (held < k + 1).sum(axis=1)
                depth = np.minimum(np.maximum(probes, enough), lists)
                probed = np.zeros((len(q), lists), bool)
                np.put_along_axis(probed, near, np.arange(lists)[None, :] < depth[:, None], axis=1)
                met = np.where(probed[:, filed_sample], q @ known.sample.T, -np.inf)
                met[ids[:, None] == known.ids[None, :]] = -np.inf
                if met.shape[1] >= 2 * k:
                    first = np.partition(met, met.shape[1] - 2 * k, axis=1)[:, met.shape[1] - 2 * k]
                    # room for another order of summation
                    first = first - 1e-9 * np.linalg.norm(q, axis=1) * widest
                else:
                    first = np.full(len(q), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:2],
                        pa.array(first),
                        pa.array([n[:d] for n, d in zip(near, depth)], pa.list_(pa.int64())),
                    ],
                    names=["query_id", "q", "tau", "lists"],
                )

    probing = staged(
        asked.mapInArrow(probe_lists, "query_id long, q array<double>, tau double, lists array<long>"), "ann-queries"
    )
    # a query has at most k rows per group
    best = staged(_best(_scan_lists(filed, probing, vectors_of, sent, lists, k, Z), k), "ann-found")
    full = best.filter(F.col("rank") == k).select("query_id")
    short = probing.join(full, "query_id", "left_anti").select(
        "query_id",
        "q",
        F.lit(float("-inf")).alias("tau"),
        F.array(*[F.lit(i).cast("long") for i in range(lists)]).alias("lists"),
    )
    again = _best(_scan_lists(filed, staged(short, "ann-again"), vectors_of, sent, lists, k, np.inf), k)
    return best.join(full, "query_id", "left_semi").unionByName(again)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best found; a row that
    occurs several times takes as many ranks."""
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    return (
        each.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _scan_lists(
    filed: DataFrame, probing: DataFrame, vectors_of: dict[int, int], sent: Broadcast, lists: int, k: int, z: float
) -> DataFrame:
    """(query_id, vec_id, score, copies): at most ``k`` rows of each pair of
    blocks of a probed list."""
    queries_of = {
        r["list"]: r["n"]
        for r in probing.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    blocks = {i: max(1, -(-n // BLOCK)) for i, n in vectors_of.items()}
    query_blocks = {i: max(1, -(-n // QUERY_BLOCK)) for i, n in queries_of.items()}

    def number(of: dict[int, int], column: str) -> Column:
        """Blocks of a list, from an array of at most max_lists numbers."""
        return F.element_at(F.array(*[F.lit(of.get(i, 1)).cast("long") for i in range(lists)]), (F.col(column) + 1).cast("int"))

    mine = filed.select(
        "list",
        F.pmod(F.xxhash64("vec_id"), number(blocks, "list")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), number(query_blocks, "list") - 1)).alias("query_block"),
        "vec_id",
        "v",
        "copies",
    )
    theirs = (
        probing.select("query_id", "q", "tau", F.explode("lists").alias("list"))
        .withColumn("query_block", F.pmod(F.xxhash64("query_id"), number(query_blocks, "list")))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), number(blocks, "list") - 1)))
        .select("list", "block", "query_block", "query_id", "q", "tau")
    )

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            types = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64(), "copies": pa.int64()}
            return pa.table({c: pa.array([], t) for c, t in types.items()})
        qid, xid = np.asarray(right["query_id"]), np.asarray(left["vec_id"])
        rows, cols, score = scan(
            qid, _matrix(right["q"]), np.asarray(right["tau"]), xid, _matrix(left["v"]), sent.value.rotation, k, z
        )
        return pa.table(
            {"query_id": qid[rows], "vec_id": xid[cols], "score": score, "copies": np.asarray(left["copies"])[cols]}
        )

    keys = ("list", "block", "query_block")
    result = "query_id long, vec_id long, score double, copies long"
    return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(group, result)
