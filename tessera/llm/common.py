"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.staging import materialise

# A word is a maximal run of characters other than ASCII white space
# (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (a null id is the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the session's shared checkpoint folder and read
    it back: lineage is cut and a lost executor re-reads files."""
    return materialise(df, f"llm-{name}")


_HELD: list[Callable[[], None]] = []  # empties the tables that this Python worker keeps


def hold(empty: Callable[[], None] | None = None) -> None:
    """Called by a task before it fills tables that the operator's next task in
    this Python worker uses again; ``empty`` empties them, none if it has none.
    Those of another operator are emptied first: a worker lives as long as its
    executor, and would keep the tables of all operators that it ever ran."""
    for other in _HELD:
        if other is not empty:
            other()
    _HELD[:] = [empty] if empty else []


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int
) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled training rows.

    Rows of the held-out fold and rows without a label never enter. The choice
    is by a hash of the id, so it does not depend on order or on other rows;
    an id labelled several times counts once, with its highest label.

    The chosen ids (at most ``max_rows``) are broadcast, so no text is
    shuffled, and the sample is staged once as its readers pass over it
    several times.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .filter(fold_of(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return staged(texts.join(F.broadcast(chosen), "doc_id"), "labelled")


# --- words of a batch of texts as 64-bit hashes, without a loop over words ---

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between batches."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class Buffer:
    """Texts joined by line feeds as one byte array; spans of it are hashed by
    polynomials taken from prefix sums, so that the cost is a few vector
    operations per byte and none per word."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        if lower:
            parts = [p.lower() for p in parts]  # ASCII letters only
        self.bytes = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        self.starts = np.concatenate(([0], ends[:-1]))  # of the texts
        self.ends = ends - 1
        solid = ~_SPACE[self.bytes]
        edge = np.diff(np.concatenate(([False], solid)).astype(np.int8))
        self.word_first, self.word_last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.word_bounds = np.searchsorted(self.word_first, np.concatenate(([0], ends)))
        self.n_words = np.diff(self.word_bounds)
        self._prefix = None

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        powers, inverse = _powers(len(self.bytes))
        if self._prefix is None:
            self._prefix = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers, out=self._prefix[1:])
        safe = np.minimum(first, len(inverse) - 1)
        return mix64((self._prefix[last] - self._prefix[first]) * inverse[safe] + (last - first).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hashes(self.word_first, self.word_last)


def slices(texts: list[str | None], chunk_bytes: int = 1 << 18):
    """Consecutive ranges (begin, end) of ``texts`` of about ``chunk_bytes``."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= chunk_bytes:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def hash_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` and the number of words of each."""
    made = [(b.words(), b.n_words) for b in (Buffer(texts[i:j], lower) for i, j in slices(texts))]
    if not made:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in made]), np.concatenate([n for _, n in made])
