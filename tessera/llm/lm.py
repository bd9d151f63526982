"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model over words with Dirichlet smoothing. Its states
are the contexts (up to ``order - 1`` words) seen in the training texts, and
one for no context. A state h that was seen c(h) times has an arc for each word
seen after it and a failure arc to the context without its oldest word:

    arc w of h        p(w | h) = (c(h w) + mass * p(w | shorter h)) / (c(h) + mass)
    failure arc of h  mass / (c(h) + mass)
    no context        p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

with a mass for each length of h. A state's failure weight is its own: near 1
for a context seen once, near 0 for one seen a million times; the words'
probabilities in a state add up to 1. A text is scored by one walk from left to right. It carries the
state, the longest context seen; a word without an arc there takes failure arcs
until it has one, and log10 weights add up. An end counts as a word; a text
begins in the state "start".

Neither the counts nor the automaton fit one machine, so both are cut up.
Texts are dealt into chunks of about ``CHUNK_BYTES`` by a hash. A chunk sends
each distinct n-gram's hash once, with the number of times it stands in the
chunk's training texts, to the range of hashes it belongs to; each range adds
up what the chunks sent and answers every chunk in the order it asked. A
chunk's answers are all of the automaton that its texts can reach, as a
context's count is that of the n-gram that ended a word before. The state
depends on the last ``order - 1`` words only, so the chunk's texts take their
steps together, in vector operations. Hot words or n-grams are one number per
chunk. Chunks and ranges have a partition each, so tasks do not grow with the
input; messages between them grow with the square of their number.

All training texts count, whole; there is no cap. Words are told apart by 62
bits. Longer n-grams have keys 18 bits wider than the corpus has bytes (at most
62 bits): one has the key of another with a probability of about 2**-18.

Defined results: a null text is empty: no word, only the end; without training
texts N = V = 0 and every word has the base model's even share; repeated rows
score alike (those of one id and text share a chunk); a very long text is one
chunk's work, in vector operations; there are no ties to break; columns other
than doc_id and text are dropped, so their names cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Buffer, fold_of, mix64, slices

CHUNK_BYTES = 8 << 20
WORD_BITS = 62
MASSES = (3000.0, 10.0)
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by its end, and
    the number of tokens of each text."""
    hashes, counts = [], []
    for i, j in slices(texts):
        buf = Buffer(texts[i:j], lower=True)
        n = buf.n_words + 1
        out = np.full(int(n.sum()), END, dtype=np.uint64)
        last = np.cumsum(n) - 1
        word = np.ones(len(out), bool)
        word[last] = False
        out[word] = buf.words()
        hashes.append(out)
        counts.append(n)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def grams(tok: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each position; the
    context before a text's first word is "start" (once, for all n)."""
    first = np.cumsum(counts) - counts
    place = np.arange(len(tok)) - np.repeat(first, counts)  # position within the text
    out = [mix64(tok + np.uint64(1))]
    back = tok
    for n in range(2, order + 1):
        # the token n - 1 places back; before the text it is "start"
        back = np.concatenate(([START], back[:-1]))
        back[place < n - 1] = START
        out.append(mix64(out[-1] * _STEP + back + np.uint64(n)))
    return out


def _arcs(tok: np.ndarray, counts: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """At each position the key of the word, and those of the longer n-grams."""
    named = grams(tok, counts, order)
    return named[0] >> np.uint64(64 - WORD_BITS), [g >> np.uint64(64 - bits) for g in named[1:]]


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _counted(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the number of flagged occurrences of each. The
    flag is sorted as the key's lowest bit, which is faster than an argsort."""
    both = np.sort((keys << np.uint64(1)) | flags.astype(np.uint64))
    key = both >> np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    flagged = np.concatenate(([0], np.cumsum(both & np.uint64(1), dtype=np.int64)))
    return key[first], np.diff(flagged[np.concatenate((first, [len(key)]))])


def _find(keys: np.ndarray, wanted: np.ndarray, bits: int) -> np.ndarray:
    """Places of ``wanted``, all of which are among the sorted distinct
    ``keys``. Keys are evenly spread hashes: their leading bits give the place
    but for a few steps."""
    lead = min(bits, max(1, len(keys)).bit_length())
    shift = np.uint64(bits - lead)
    begins = np.searchsorted(keys, np.arange(1 << lead, dtype=np.uint64) << shift)
    at = begins[wanted >> shift]
    late = np.flatnonzero(keys[at] != wanted) if len(wanted) else at
    while len(late):
        at[late] += 1
        late = late[keys[at[late]] != wanted[late]]
    return at


def _asked(texts: list[str | None], train: np.ndarray, order: int, bits: int):
    """Sorted distinct keys of a chunk's words and their training counts, and
    the same of its longer n-grams."""
    tok, counts = tokens(texts)
    training = np.repeat(train.astype(bool), counts)
    word, arcs = _arcs(tok, counts, order, bits)
    longer = np.concatenate(arcs) if arcs else np.zeros(0, np.uint64)
    return *_counted(word, training), *_counted(longer, np.concatenate([training] * len(arcs)) if arcs else training[:0])


def _walk(texts: list[str | None], totals, masses: tuple[float, ...], bits: int, z: float, n_texts: int):
    """tokens, known tokens, base score and model score of each text.
    ``totals`` gives the training counts of the chunk's distinct words and
    longer n-grams in the order of their keys."""
    tok, n = tokens(texts)
    word, arcs = _arcs(tok, n, len(masses) + 1, bits)
    first = np.cumsum(n) - n
    count = totals[0][_find(_distinct(word), word, WORD_BITS)].astype(np.float64)
    p = (count + 0.5) / z
    weight = base = np.log10(p)
    known = count > 0
    keys = _distinct(np.concatenate(arcs)) if arcs else word[:0]
    for key, mass in zip(arcs, masses):
        # the state's count: its n-gram ended one word before
        state = np.concatenate(([0.0], count[:-1]))
        state[first] = n_texts
        count = totals[1][_find(keys, key, bits)].astype(np.float64)
        failure = mass / (state + mass)
        p = count / (state + mass) + failure * p
        weight = np.where(count > 0, np.log10(p), np.log10(failure) + weight)
    total = lambda v: np.add.reduceat(v, first) if len(n) else np.zeros(0)
    return n, total(known.astype(np.int64)), total(base), total(weight)


def score(
    docs: DataFrame,
    folds: int = 5,
    held_out: int = 1,
    masses: tuple[float, ...] = MASSES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose fold is ``held_out`` are scored but not learned from. ``masses``
    has the mass of the states of one word, of two, and so on; the order is
    their number and one."""
    order = len(masses) + 1
    rows = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        (fold_of(F.col("doc_id"), folds) != held_out).alias("train"),
    )
    # an end counts as a byte, so that texts without a word make chunks too
    size, n_texts = rows.agg(F.sum(F.octet_length("text") + 1), F.count_if("train")).first()
    n_chunks = max(1, -(-(size or 0) // chunk_bytes))
    bits = min(WORD_BITS, int(size or 0).bit_length() + 18)
    # as many ranges of hashes as chunks: a range holds a chunk's worth of n-grams
    ranges = n_chunks
    n_train, vocabulary = _training_size(rows, ranges)
    z = n_train + 0.5 * (vocabulary + 1)
    # a partition a chunk: tasks stay as they are however many chunks there are
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks))).repartition(n_chunks, "chunk")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        words, word_counts, arcs, arc_counts = _asked(table["text"].to_pylist(), np.asarray(table["train"]), order, bits)
        sent = [(_cut(words, ranges, WORD_BITS), words, word_counts), (_cut(arcs, ranges, bits), arcs, arc_counts)]
        used = [r for r in range(ranges) if any(c[r] < c[r + 1] for c, _, _ in sent)]
        columns = {"chunk": pa.array([key[0].as_py()] * len(used), pa.int64()), "bucket": pa.array(used, pa.int64())}
        for name, (c, keys, counts) in zip(("words", "arcs"), sent):
            columns[name] = pa.array([_packed_keys(keys[c[r] : c[r + 1]]) for r in used], pa.binary())
            columns[f"{name[:-1]}_counts"] = pa.array([_packed(counts[c[r] : c[r + 1]]) for r in used], pa.binary())
        return pa.table(columns)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        out = {"chunk": table["chunk"], "bucket": table["bucket"]}
        for name in ("word", "arc"):
            keys = [_unpacked_keys(x) for x in table[f"{name}s"].to_pylist()]
            counts = np.concatenate([_unpacked(x) for x in table[f"{name}_counts"].to_pylist()])
            every = np.concatenate(keys)
            distinct = _distinct(every)
            place = np.searchsorted(distinct, every)
            total = np.bincount(place, weights=counts, minlength=len(distinct)).astype("<u8")[place]
            ends = np.cumsum([len(k) for k in keys])
            out[f"{name}_totals"] = pa.array([_packed(total[e - len(k) : e]) for k, e in zip(keys, ends)], pa.binary())
        return pa.table(out)

    def walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left["text"].to_pylist()
        if not texts:
            return pa.table({c: pa.array([], t) for c, t in _OUT.items()})
        came = right.sort_by("bucket")
        totals = [np.concatenate([_unpacked(x) for x in came[c].to_pylist()]) for c in ("word_totals", "arc_totals")]
        n, known, base, model = _walk(texts, totals, masses, bits, z, n_texts)
        return pa.table(
            {
                "doc_id": left["doc_id"].cast(pa.string()),
                "held_out": pa.array([not t for t in left["train"].to_pylist()]),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(model, pa.float64()),
            }
        )

    asked = chunked.groupBy("chunk").applyInArrow(ask, _MESSAGE).repartition(ranges, "bucket")
    answered = asked.groupBy("bucket").applyInArrow(answer, _ANSWER).repartition(n_chunks, "chunk")
    scored = (
        chunked.groupBy("chunk")
        .cogroup(answered.groupBy("chunk"))
        .applyInArrow(walk, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select(
        F.col("doc_id").cast(rows.schema["doc_id"].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


_MESSAGE = "chunk long, bucket long, words binary, word_counts binary, arcs binary, arc_counts binary"
_ANSWER = "chunk long, bucket long, word_totals binary, arc_totals binary"
_OUT = {
    "doc_id": pa.string(),
    "held_out": pa.bool_(),
    "n_tokens": pa.int64(),
    "n_known": pa.int64(),
    "base_score": pa.float64(),
    "score": pa.float64(),
}


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs, compressed."""
    width = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
    raw = counts.astype(width.newbyteorder("<")).tobytes()
    return bytes([width.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[1:9], "little")
    raw = pa.decompress(packed[9:], size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{packed[0]}").astype(np.uint64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps; the first bytes of all steps, then the second
    ones, and so on, so that the nearly empty high bytes compress well."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T.copy()
    raw = planes[: planes.any(axis=1).nonzero()[0].max(initial=0) + 1].tobytes()
    return len(keys).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked_keys(packed: bytes) -> np.ndarray:
    n, size = (int.from_bytes(packed[i : i + 8], "little") for i in (0, 8))
    planes = np.zeros((8, n), np.uint8)
    if n:
        raw = pa.decompress(packed[16:], size, codec="zstd", asbytes=True)
        planes[: size // n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _cut(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Sorted keys of ``bits`` bits cut at the bounds of the hash ranges."""
    bounds = np.array([(r << bits) // ranges for r in range(1, ranges)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)])).astype(np.int64)


def _training_size(rows: DataFrame, ranges: int) -> tuple[int, int]:
    """Number of training tokens and of distinct ones. Each batch of texts
    sends its distinct words' hashes to their range, which counts them."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        total = 0
        for batch in batches:
            tok, _ = tokens(batch.column(0).to_pylist())
            total += len(tok)
            kept.append(np.unique(tok))
            if sum(map(len, kept)) > 2_000_000:
                kept = [np.unique(np.concatenate(kept))]
                if len(kept[0]) > 1_000_000:
                    yield from send(kept[0], total)
                    kept, total = [], 0
        if total:
            yield from send(np.unique(np.concatenate(kept)), total)

    def send(keys: np.ndarray, total: int) -> Iterator[pa.RecordBatch]:
        keys = np.unique(mix64(keys))
        cuts = _cut(keys, ranges, 64)
        used = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
        yield from pa.table(
            {
                "tokens": pa.array([total] + [0] * (len(used) - 1), pa.int64()),
                "bucket": pa.array(used, pa.int64()),
                "keys": pa.array([_packed_keys(keys[cuts[r] : cuts[r + 1]]) for r in used], pa.binary()),
            }
        ).to_batches()

    def distinct(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpacked_keys(x) for x in table["keys"].to_pylist()])
        return pa.table(
            {
                "tokens": pa.array([sum(table["tokens"].to_pylist())], pa.int64()),
                "words": pa.array([len(_distinct(keys))], pa.int64()),
            }
        )

    got = (
        rows.filter("train")
        .select("text")
        .mapInArrow(words, "tokens long, bucket long, keys binary")
        .repartition(ranges, "bucket")
        .groupBy("bucket")
        .applyInArrow(distinct, "tokens long, words long")
        .agg(F.sum("tokens"), F.sum("words"))
        .first()
    )
    return int(got[0] or 0), int(got[1] or 0)
