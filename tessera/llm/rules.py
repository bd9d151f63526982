"""Quality rules on whole texts, with an isolation forest over their figures.

Base rules count words, symbols, repeated lines and words in repeated
eight-word windows, and fail texts that are too short or too repetitive. From
these and a few more figures (as ratios, so that neither length nor language
decides) an isolation forest learns what ordinary documents look like: random
splits isolate an odd document after few steps, so a short mean path length
means an anomaly. A document is kept if the base rules pass and its anomaly
score is at most the threshold.

Forest and threshold are learnt from all labelled rows that pass the base
rules. Trees split the range of all of them; where a tree goes on to split is
decided by ``sample`` rows of label 1 of its own, as an isolation forest does,
and the path lengths by how many of all label-1 rows lie in each leaf. The
threshold is the one that tells the labels of all rows apart best while losing
at most ``max_loss`` of label 1. All counts are taken over whole texts of all
rows, a map without a shuffle; of the labelled rows only labels and figures
are shuffled and staged.

Defined results: null and empty texts have no word, all counts 0, and fail
the base rules; without labelled rows no document is an anomaly; repeated rows
give repeated results; columns other than doc_id and text are dropped, so
their names cannot clash; a very long text is counted whole; an empty table
gives an empty result; equal scores are judged alike by one threshold; an id
labelled several times counts with its highest label. The threshold is set on
the labelled rows that the forest is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Buffer, mix64, slices, staged

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
# Shares of symbols, capitals, repeated lines, words in repeated windows and
# words equal to the one before, on a log scale that begins at these values.
SCALE = np.array([0.005, 0.05, 0.1, 0.05, 0.02])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TREES, SAMPLE = 200, 256
# Scores are cut into so many bins; sums run along the bins, then inside each.
BINS = 1 << 16


def _members(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[np.frombuffer(chars.encode(), np.uint8)] = 1
    return table


# The symbols that the base rules count.
_SYMBOL = _members("#*$%&|<>")
_UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
# Bytes that begin a character of a word: no white space, no continuation.
_CHAR = np.ones(256, dtype=np.int64)
_CHAR[[9, 10, 11, 12, 13, 32]] = 0
_CHAR[0x80:0xC0] = 0


def figures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ratios): one row per text, counts as in ``COUNTS`` and ratios
    as in ``SCALE``."""
    made = [_figures(texts[i:j]) for i, j in slices(texts)]
    if not made:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(SCALE)))
    return np.concatenate([c for c, _ in made]), np.concatenate([r for _, r in made])


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _figures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    buf = Buffer(texts)
    docs = len(texts)
    at = np.concatenate((buf.starts, [len(buf.bytes)]))
    tally = lambda table: _per_text(table[buf.bytes], at)
    chars = tally(_CHAR)
    words, n = buf.words(), buf.n_words
    doc_of_word = np.repeat(np.arange(docs), n)

    # lines that hold a word, by text
    feeds = np.flatnonzero(buf.bytes == 10)
    line_first = np.concatenate(([0], feeds[:-1] + 1))
    holds = np.searchsorted(buf.word_first, feeds) > np.searchsorted(buf.word_first, line_first)
    line_first, line_last = line_first[holds], feeds[holds]
    doc_of_line = np.searchsorted(buf.starts, line_first, side="right") - 1
    line_keys = mix64(buf.hashes(line_first, line_last) + doc_of_line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first_of = np.unique(line_keys, return_index=True)[1]
    n_lines = np.bincount(doc_of_line, minlength=docs)
    dup_lines = n_lines - np.bincount(doc_of_line[first_of], minlength=docs)

    # words in windows that occur more than once in their text
    repeated = np.zeros(docs, np.int64)
    if len(words) >= WINDOW:
        w = np.zeros(len(words) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            w = w * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(w)]
        inside = doc_of_word[: len(w)] == doc_of_word[WINDOW - 1 :]
        begin = np.flatnonzero(inside)
        keys = mix64(w[begin] + doc_of_word[begin].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, begin[twice], 1)
        np.add.at(cover, begin[twice] + WINDOW, -1)
        repeated = _per_text((np.cumsum(cover[:-1]) > 0).astype(np.int64), buf.word_bounds)

    symbols = tally(_SYMBOL)
    counts = np.stack([n, chars, symbols, dup_lines, repeated], axis=1)
    words_at_least = np.maximum(n, 1)
    chars_at_least = np.maximum(chars, 1)
    same_as_before = np.zeros(len(words), np.int64)
    same_as_before[1:] = (words[1:] == words[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
    shares = [
        symbols / chars_at_least,
        tally(_UPPER) / chars_at_least,
        dup_lines / np.maximum(n_lines, 1),
        repeated / words_at_least,
        _per_text(same_as_before, buf.word_bounds) / words_at_least,
    ]
    return counts, np.log1p(np.stack(shares, axis=1) / SCALE)


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeated = counts[:, 0], counts[:, 4]
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n points; n may
    be a mean, so it is linear between 1, 2 and 3 points."""
    n = np.maximum(np.asarray(n, dtype=float), 1.0)
    path = lambda m: 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    return np.where(n >= 3, path(np.maximum(n, 3.0)), np.interp(n, [1.0, 2.0, 3.0], [0.0, 1.0, path(3.0)]))


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 at a leaf), split value, children,
    and at leaves the path length; ``depth`` of each node."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: np.ndarray
    sample: int
    threshold: float = float("inf")

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of every row."""
        rows = np.arange(len(x))
        for feature, value, child in zip(self.feature, self.value, self.child):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = (x[rows, np.maximum(f, 0)] >= value[node]).astype(np.int64)
                node = np.where(inner, child[node] + right, node)
            yield node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 to the minus mean path length, scaled."""
        total = np.zeros(len(x))
        for path, node in zip(self.path, self.leaves(x)):
            total += path[node]
        return 2.0 ** (-total / max(1, len(self.feature)) / max(1e-9, float(_expected(self.sample))))

    def masses(self, x: np.ndarray) -> np.ndarray:
        """How many of the rows lie in each leaf: trees x nodes."""
        return np.stack([np.bincount(node, minlength=self.feature.shape[1]) for node in self.leaves(x)])

    def weigh(self, masses: np.ndarray, rows: int) -> None:
        """Path lengths by the share of ``rows`` rows in each leaf."""
        self.path = self.depth + _expected(masses * (self.sample / rows))


def grow(
    x: np.ndarray, space: np.ndarray | None = None, trees: int = TREES, sample: int = SAMPLE, depth_limit: int = 14, seed: int = 11
) -> Forest:
    """Isolation trees, each on ``sample`` random rows of ``x``. Splits are
    drawn over the box that the node covers, which at the root is the range of
    the rows of ``space``: also where ``x`` is constant or has no row, as that
    is where anomalies lie."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    space = x if space is None or not len(space) else space
    built = []
    for _ in range(trees):
        nodes: list[tuple[int, float, int, float, int]] = [(-1, 0.0, 0, 0.0, 0)]
        start = (0, x[rng.choice(len(x), sample, replace=False)], 0, space.min(0), space.max(0))
        stack = [start]
        while stack:
            node, part, depth, low, high = stack.pop()
            open_ = np.flatnonzero(high > low)
            if depth >= depth_limit or len(part) <= 1 or not len(open_):
                nodes[node] = (-1, 0.0, 0, depth + float(_expected(len(part))), depth)
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            nodes[node] = (f, cut, len(nodes), 0.0, depth)
            right = part[:, f] >= cut
            for k, side in enumerate((part[~right], part[right])):
                box = low.copy(), high.copy()
                box[1 - k][f] = cut
                stack.append((len(nodes), side, depth + 1, *box))
                nodes.append((-1, 0.0, 0, depth + 1.0, depth + 1))
        built.append(nodes)
    size = max(map(len, built))
    padded = [n + [(-1, 0.0, 0, 0.0, 0)] * (size - len(n)) for n in built]
    columns = [np.array([[node[k] for node in n] for n in padded]) for k in range(5)]
    return Forest(columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3], columns[4], sample)


def threshold(scored: DataFrame, max_loss: float) -> float:
    """Score above which a row is an anomaly: best difference of the two
    labels' shares above it, losing at most ``max_loss`` of label 1. Exact over
    all rows of ``scored`` (score, good), which are counted by score; running
    counts go along the bins of the scores and inside each bin."""
    tally = scored.groupBy("score").agg(
        F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"), F.floor(F.col("score") * BINS).alias("bin")
    )
    tally = staged(tally, "scores")
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over at most BINS + 1 rows
    bins = tally.groupBy("bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    good, bad = bins.agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not good or not bad:
        return float("inf")
    before = bins.select("bin", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in "gb"])
    inside = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c, n: (F.col(f"{c}_before") + F.sum(c).over(inside)) / F.lit(float(n))
    cuts = tally.join(F.broadcast(before), "bin").select("score", (1 - share("g", good)).alias("lost"), (1 - share("b", bad)).alias("caught"))
    best = cuts.filter(F.col("lost") <= max_loss).agg(F.min(F.struct((F.col("lost") - F.col("caught")).alias("gain"), "score"))["score"]).first()[0]
    above = tally.filter(F.col("score") > best).agg(F.min("score")).first()[0]
    return best if above is None else (best + above) / 2


def labelled_figures(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, good, ratios) of every labelled row that passes the base rules,
    staged. Figures are taken before the join, so that no text is shuffled."""
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("label") > 0).alias("good"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ratios = figures(batch.column(1).to_pylist())
            passed = np.flatnonzero(~base_failed(counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(passed)), pa.array(list(ratios[passed]), pa.list_(pa.float64()))],
                names=["doc_id", "ratios"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    passing = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).mapInArrow(run, f"doc_id {id_type}, ratios array<double>")
    return staged(passing.join(known, "doc_id").select("doc_id", "good", "ratios"), "figures")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(SCALE))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_loss: float = 0.002) -> Forest | None:
    """Forest and threshold from all labelled rows; None without label-1 rows.
    The driver gets each tree's ``SAMPLE`` rows (their figures), the ranges and
    the masses of the leaves."""
    rows = labelled_figures(docs, labels, label)
    of = [F.col("ratios")[k] for k in range(len(SCALE))]
    n, *ends = rows.agg(F.count_if("good"), *map(F.min, of), *map(F.max, of)).first()
    if not n:
        return None
    drawn = TREES * SAMPLE
    by = F.xxhash64(F.col("doc_id").cast("string"), F.lit(label))
    near = rows.filter("good").filter(F.pmod(by, F.lit(1 << 40)) < int(min(1.0, 2 * drawn / n) * (1 << 40)))
    grown_on = near.orderBy(by, "doc_id", "ratios").limit(drawn).select("ratios").toArrow().combine_chunks()
    x = _matrix(grown_on.column(0).combine_chunks()) if grown_on.num_rows else np.zeros((0, len(SCALE)))
    forest = grow(x, np.array(ends).reshape(2, -1))
    trees, nodes = forest.feature.shape
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses = np.zeros((trees, nodes), np.int64)
        for batch in batches:
            masses += sent.value.masses(_matrix(batch.column(0)))
        held = np.flatnonzero(masses)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(masses.ravel()[held])], names=["leaf", "mass"])

    held = rows.filter("good").select("ratios").mapInArrow(weigh, "leaf long, mass long").groupBy("leaf").agg(F.sum("mass").alias("mass")).toArrow()
    masses = np.zeros(trees * nodes)
    masses[np.asarray(held.column(0))] = np.asarray(held.column(1))
    forest.weigh(masses.reshape(trees, nodes), n)
    weighed = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(weighed.value.score(_matrix(batch.column(0)))), batch.column(1)], names=["score", "good"]
            )

    forest.threshold = threshold(rows.select("ratios", "good").mapInArrow(score, "score double, good boolean"), max_loss)
    return forest


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly (score) and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            counts, ratios = figures(batch.column(1).to_pylist())
            failed = base_failed(counts)
            anomaly = known.score(ratios) if known else np.zeros(len(ratios))
            kept = ~failed & (anomaly <= known.threshold if known else True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[:, k]) for k in range(len(COUNTS))], pa.array(failed), pa.array(anomaly), pa.array(kept)],
                names=["doc_id", *COUNTS, "base_failed", "anomaly", "kept"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(run, f"doc_id {id_type}, {counts}, base_failed boolean, anomaly double, kept boolean")
