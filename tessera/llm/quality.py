"""Document quality by a linear model on n-gram indicators (naive Bayes
support vectors).

Every text becomes the set of its n-grams: words, pairs of word shapes, and
marks for a word that repeats the one before. An indicator's value is the log
of the ratio of its frequencies in the two classes, so rare chance n-grams
weigh little and telling ones much; on these scaled indicators a linear
support vector machine with hinge loss is trained by dual coordinate descent,
and its margins become probabilities by a logistic curve fitted on rows that
the training did not see.

The fit uses at most ``max_rows`` labelled rows, chosen by a hash of the id
(the bound of the fit). Scoring covers whole texts of all rows, is a map over
rows, and needs the weights of the n-grams that occurred in the fit only.

Defined results: null and empty texts have no n-gram and get the score of the
model's bias; without labelled rows of both classes every score is the share
of label 1 (0 without labels); repeated rows score alike; extra columns pass
through and one named ``score`` is replaced; an empty table gives an empty result; a
very long text is read whole, except that a single word's shape is that of its
first 64 characters (the word itself is hashed whole); there are no ties to
break, as rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample

_RUNS = re.compile(r"(.)\1+")


class _ShapeTable(dict):
    """For str.translate: letters become a or A, digits 0; other signs stand
    for themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        return kind


_SHAPE = _ShapeTable()


class _Looked(dict):
    """Word -> hash of the folded word (high half) and of its shape; bounded,
    as words repeat."""

    def __missing__(self, word: str) -> int:
        shape = word[:64].translate(_SHAPE)
        shape = _RUNS.sub(r"\1", shape)[:12]
        plain = word.strip(".,;:!?\"'()").lower()
        found = crc32(("w" + plain).encode("utf-8", "replace")) << 32 | crc32(("s" + shape).encode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = found
        return found


_LOOKED = _Looked()
_LOW = np.uint64(0xFFFFFFFF)


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct n-gram hashes (unsigned 32 bits) of a whole text."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint32)
    looked = np.array([_LOOKED[w] for w in words], dtype=np.uint64)
    shapes = looked & _LOW
    plain = looked >> np.uint64(32)
    pairs = (shapes[:-1] * np.uint64(0x9E3779B1) + shapes[1:]) & _LOW
    triples = looked[:-2] * np.uint64(0x9E3779B97F4A7C15) + looked[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + looked[2:]
    n = len(words)
    distinct = np.unique(plain)
    # marks: words equal to the one before, words per distinct word, repeated
    # triples, and length, each on a coarse scale
    same = int(8 * np.log2(1 + 100 * float((looked[1:] == looked[:-1]).sum()) / n))
    spare = int(4 * np.log2(n / len(distinct)))
    again = int(10 * (1 - len(np.unique(triples)) / max(1, len(triples)))) if len(triples) else 0
    marks = [crc32(b"%c%d" % (k, v)) for k, v in zip(b"rutn", (same, spare, again, int(np.log2(n))))]
    return np.unique(np.concatenate([distinct, shapes, pairs, np.array(marks, np.uint64)])).astype(np.uint32)


@dataclass
class Model:
    grams: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0

    def margin(self, grams: np.ndarray) -> float:
        if not len(self.grams) or not len(grams):
            return self.bias
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        known = at[self.grams[at] == grams]
        return float(self.weights[known].sum() / np.sqrt(max(1, len(known))) + self.bias)


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    p, n = np.full(size, alpha), np.full(size, alpha)
    for x, y in zip(rows, label):
        (p if y else n)[x] += 1
    return np.log((p / p.sum()) / (n / n.sum()))


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], label: np.ndarray, size: int, cost: float, epochs: int, seed: int = 7
) -> np.ndarray:
    """Weights (the last one is the bias) of the hinge-loss machine: one dual
    variable a row, each step solved exactly and clipped to [0, cost]."""
    y = np.where(label > 0, 1.0, -1.0)
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    # a row of the rarer class costs more, so both classes weigh the same
    share = max(1e-9, (y > 0).mean())
    upper = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / max(1e-9, 1 - share))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + w[size]) - 1.0
            if (alpha[i] <= 0 and g >= 0) or (alpha[i] >= upper[i] and g <= 0):
                continue
            worst = max(worst, abs(g))
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[x] += step * v
            w[size] += step
        if worst < 0.01:
            break
    return w


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (0 or above) and shift of the logistic curve, by Newton steps."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (label - p) - 0.01 * beta * [1, 0]
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.01, 1e-6])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    if beta[0] <= 0:
        rate = min(max(float(label.mean()), 1e-6), 1 - 1e-6)
        return 0.0, float(np.log(rate / (1 - rate)))
    return float(beta[0]), float(beta[1])


def train(rows: list[np.ndarray], label: np.ndarray, cost: float = 1.0, epochs: int = 30, min_rows: int = 2) -> Model:
    """Model from n-gram sets and labels; every fifth row calibrates."""
    label = label.astype(np.float64)
    prior = float(label.mean()) if len(label) else 0.0
    nothing = Model(np.zeros(0, np.uint32), np.zeros(0), 0.0, prior=prior)
    if len(set(label.tolist())) < 2:
        return nothing
    fit = np.arange(len(rows)) % 5 != 0
    if len(set(label[fit].tolist())) < 2 or len(set(label[~fit].tolist())) < 2:
        fit = np.ones(len(rows), bool)
    chosen = [r for r, f in zip(rows, fit) if f]
    grams, seen = np.unique(np.concatenate(chosen), return_counts=True) if chosen else (np.zeros(0, np.uint32), None)
    grams = grams[seen >= min_rows] if len(grams) else grams
    if not len(grams):
        return nothing
    index = []
    for r in chosen:
        at = np.searchsorted(grams, r)
        at[at == len(grams)] = 0
        index.append(at[grams[at] == r])
    ratio = log_count_ratios(index, label[fit], len(grams))
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in index]
    w = dual_coordinate_descent(index, values, label[fit], len(grams), cost, epochs)
    model = Model(grams, w[:-1] * ratio, float(w[-1]), prior=prior)
    check = ~fit if (~fit).any() else fit
    margins = np.array([model.margin(r) for r, c in zip(rows, check) if c])
    model.slope, model.shift = platt(margins, label[check])
    return model


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 5,
    held_out: int = 0,
    max_rows: int = 6_000,
) -> Model:
    """Model from at most ``max_rows`` labelled rows outside the held-out fold.
    Only n-gram hashes and labels of those rows reach the driver."""
    sample = labelled_sample(docs, labels, label, folds, held_out, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ngrams(x.as_py()).astype("<u4").tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), batch.column(1), batch.column(2)], names=["grams", "label", "turn"])

    turn = F.xxhash64(F.col("doc_id").cast("string"))
    got = sample.select("text", "label", turn.alias("turn")).mapInArrow(run, "grams binary, label int, turn long").toArrow()
    order = np.argsort(np.asarray(got.column(2)), kind="stable")
    rows = [np.frombuffer(got.column(0)[int(i)].as_py(), "<u4") for i in order]
    return train(rows, np.asarray(got.column(1))[order] if len(order) else np.zeros(0))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    kept = docs.select(*[c for c in docs.columns if c != "score"])
    if not len(model.grams):
        return kept.withColumn("score", F.lit(model.prior))
    at = kept.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            z = np.array([m.margin(ngrams(x.as_py())) for x in batch.column(at)], dtype=np.float64) * m.slope + m.shift
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*batch.schema.names, "score"]
            )

    return kept.mapInArrow(run, kept.withColumn("score", F.lit(0.0)).schema)
