"""Near-duplicate documents by order min-hashing and banded alignment.

A text is the sequence of its five-word shingles (lower-cased words; a shorter
text is one shingle of all its words). Every shingle is labelled with its
occurrence number, so repeats count. Each of ``SKETCHES`` hash functions picks
the ``PICKS`` smallest labelled shingles and keeps them in text order; the
hash of that short sequence is a bucket. Two texts of similarity 0.8 share a
bucket of one function with probability about 0.8 ** PICKS = 0.33, and miss
all 24 with probability 7e-5 (3e-4 at 16 shingles, where picks are drawn from
few). Texts of at most ``SHORT`` shingles have exact keys too: the sequence
itself and what is left of it without as many shingles as a similar text may
lack, so no similar pair with a text of 15 shingles or fewer is missed. Texts that share a passage but little else, or
the same shingles in another order, hardly ever meet.

Candidates are verified by aligning the two shingle sequences in order:
similarity = matched / (shingles of both - matched), which equals the Jaccard
similarity of the labelled shingles when the order agrees. A pair links at
0.8 or more, and documents are classed by the connected components.

Members of a bucket are compared with hubs until nothing is left to compare.
The first hub is the most central member: the one whose buckets hold the most
members in all, as the original of many edited copies does. Then components
are formed from all links so far, a hub leaves its bucket after its turn, and
a bucket whose members are all in one component is closed. Buckets still open
get ``GROWTH`` times as many hubs a turn, chosen by hash, and hubs meet only
members of other components. When no bucket is open, every pair that shares a
bucket was compared, is in one class already, or differs too much in length to
be similar. There is no cap on turns or comparisons: a bucket of n texts none
of which are similar costs up to n * n of them, one of copies about n. After
the first turn a pair is verified only if its profiles (shingles in each of
``CELLS`` ranges of hashes) allow the similarity: their distance is at most
the number of unmatched shingles, so no similar pair is lost. Profiles are
compared in blocks of ``BLOCK`` by ``BLOCK`` texts; only survivors become rows.

Equal texts are one text (a 64-bit hash tells texts apart) and share a class
without comparison. Rows per bucket and per class are counted map-side; joins
on a popular text, hub or class are of many narrow rows with one.

Defined results: a null text is a class of its own; texts without a word are
equal only to the same text; repeated rows share a class; a null id never
names a class that has another id; columns other than doc_id and text are
dropped by ``classes`` and kept by ``keep_one``, whatever their names; a very
long text is sketched in pieces and aligned whole; the smallest id names a
class, so there is no tie; an empty table gives an empty result. ``n_links``
counts the pairs that hubs met, which join all similar texts but need not be
all similar pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Buffer, hold, mix64, slices, staged

SHINGLE = 5
SIMILARITY = 0.8
PICKS = 5
SKETCHES = 24
GROWTH = 16  # of the number of hubs, from turn to turn
SHORT = 18  # no text of 15 shingles or fewer is similar to one of more than 18
CELLS = 256
BLOCK = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of consecutive texts (``n`` words each) and
    their number by text."""
    bounds = np.concatenate(([0], np.cumsum(n)))
    m = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    if len(words) >= SHINGLE:
        full = np.zeros(len(words) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            full = full * _STEP + words[k : k + len(full)]
    else:
        full = np.zeros(0, np.uint64)
    begin = np.repeat(bounds[:-1], m)
    within = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    at = begin + within
    out = np.zeros(len(at), np.uint64)
    long = np.repeat(n >= SHINGLE, m)
    out[long] = full[at[long]]
    for i, d in zip(np.flatnonzero(~long), np.flatnonzero((n > 0) & (n < SHINGLE))):
        h = int(n[d])
        for w in words[bounds[d] : bounds[d + 1]].tolist():
            h = (h * int(_OTHER) + w) % 2**64
        out[i] = h
    return mix64(out), m


def labelled(sh: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with their occurrence number within the text."""
    doc = np.repeat(np.arange(len(m), dtype=np.uint64), m)
    key = mix64(sh + doc * _OTHER)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    number = np.arange(len(key)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(key)]))))
    occurrence = np.zeros(len(key), np.uint64)
    occurrence[order] = number.astype(np.uint64)
    return mix64(sh + occurrence * _STEP)


def sketches(sh: np.ndarray, m: np.ndarray, picks: int = PICKS, functions: int = SKETCHES) -> np.ndarray:
    """(texts, functions) bucket hashes; rows of texts without shingles are 0."""
    out = np.zeros((len(m), functions), np.uint64)
    if not len(sh):
        return out
    x = labelled(sh, m)
    doc = np.repeat(np.arange(len(m)), m)
    first = np.cumsum(m) - m
    # only values below a text's bound can be among its smallest: about 16 a text
    share = np.minimum(1.0, (picks + 11) / np.maximum(m, 1))
    bound = (np.minimum(share, 1 - 2**-20) * 2.0**64).astype(np.uint64)
    bound[share >= 1] = np.uint64(2**64 - 1)
    bounds = np.repeat(bound, m)
    need = np.minimum(m, picks)
    odd = mix64(np.arange(1, functions + 1, dtype=np.uint64)) | np.uint64(1)
    for j in range(functions):
        h = (x ^ odd[j]) * odd[j] * _STEP
        h ^= h >> np.uint64(29)
        at = np.flatnonzero(h <= bounds)
        short = np.flatnonzero(np.bincount(doc[at], minlength=len(m)) < need)
        if len(short):  # too few below the bound: all values of these texts
            again = [np.arange(first[d], first[d] + m[d]) for d in short]
            at = np.union1d(at, np.concatenate(again))
        of = doc[at]
        order = np.lexsort((h[at], of))
        of = of[order]
        begin = np.searchsorted(of, np.arange(len(m)))
        rank = np.arange(len(of)) - begin[of]
        chosen = np.sort(at[order][rank < picks])  # back in text order
        of = doc[chosen]
        place = np.arange(len(of)) - np.searchsorted(of, np.arange(len(m)))[of]
        power = _STEP ** np.arange(picks, dtype=np.uint64)
        part = mix64(sh[chosen] + np.uint64(j)) * power[place]
        total = np.concatenate(([np.uint64(0)], np.cumsum(part)))
        ends = np.cumsum(need)
        out[:, j] = mix64(total[ends] - total[ends - need] + odd[j])
    out[m == 0] = 0
    return out


def short_keys(sh: np.ndarray, words: np.ndarray) -> list[int]:
    """Hashes of all sequences that a similar text can share with this one of
    at most ``SHORT`` shingles, itself included.

    Similarity 0.8 leaves at most a fifth of a text's shingles unmatched.
    Overlapping shingles can be unmatched in the middle, with matches on both
    sides, only where a word comes again within three words; other texts lose
    shingles at their ends only."""
    m = len(sh)
    most = int(m * (1 - SIMILARITY) + 1e-9)
    if any((words[d:] == words[:-d]).any() for d in (1, 2, 3) if len(words) > d):
        left = {tuple(c) for k in range(most + 1) for c in combinations(sh.tolist(), m - k)}
    else:
        left = {tuple(sh[i : m - j].tolist()) for i in range(most + 1) for j in range(most + 1 - i)}
    out = []
    for kept in left:
        h = len(kept)
        for x in kept:
            h = (h * int(_OTHER) + x) % 2**64
        out.append(h)
    return mix64(np.array(out, np.uint64)).tolist()


def _word_rows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j in slices(texts):
        buf = Buffer(texts[i:j], lower=True)
        yield buf.words(), buf.n_words


def _labels(sh: np.ndarray) -> np.ndarray:
    return labelled(sh, np.array([len(sh)]))


def band_of(a: int, b: int, least: float = SIMILARITY) -> int:
    """How far the positions of matched shingles can be apart if the
    similarity is at least ``least``: unmatched shingles of both sides."""
    return int((a + b) * (1 - least) / (1 + least) + 1e-9)


def banded_alignment(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences among matches whose
    positions differ by at most ``band``, one vector step a row."""
    width = 2 * band + 1
    row = np.zeros(width + 1, np.int64)  # row[d]: best with b up to i + d - band
    padded = np.full(len(b) + 2 * width + 2, -1, dtype=np.int64)
    padded[width : width + len(b)] = b.view(np.int64) if b.dtype == np.uint64 else b
    left = a.view(np.int64) if a.dtype == np.uint64 else a
    valid = np.zeros(len(padded), bool)
    valid[width : width + len(b)] = True
    for i in range(len(a)):
        lo = width + i - band
        if lo >= len(padded):
            break
        window = padded[lo : lo + width]
        ok = valid[lo : lo + width] & (window == left[i])
        n = len(window)
        match = row[:n] + ok  # diagonal
        up = row[1 : n + 1]  # b position kept, a advanced
        row[:n] = np.maximum.accumulate(np.maximum(match, up))
        row[n:] = row[n - 1]
    return int(row[:width].max())


def similarity(wa: np.ndarray, wb: np.ndarray, least: float = SIMILARITY) -> float:
    """Order-keeping similarity of two texts given as word hashes; 0 where it
    is certain to be below ``least``."""
    (sa, _), (sb, _) = (shingles(w.astype(np.uint64), np.array([len(w)])) for w in (wa, wb))
    na, nb = len(sa), len(sb)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    score = lambda m: m / (na + nb - m)
    la, lb = _labels(sa), _labels(sb)
    order = np.argsort(lb)
    at = np.searchsorted(lb, la, sorter=order)
    at[at == nb] = 0
    place = order[at]
    both = lb[place] == la
    most = int(both.sum())  # no alignment matches more
    if score(most) < least:
        return 0.0
    band = band_of(na, nb, least)
    i, j = np.flatnonzero(both), place[both]
    near = np.abs(i - j) <= band
    j = j[near]
    if len(j) == most and (np.diff(j) > 0).all():
        return score(most)
    tails: list[int] = []  # longest increasing run of matches: an alignment
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    if score(len(tails)) >= least:
        return score(len(tails))
    found = score(banded_alignment(sa, sb, band))
    return found if found >= least else 0.0


def _text_id(df: DataFrame) -> DataFrame:
    return df.withColumn("tid", F.when(F.col("text").isNotNull(), F.xxhash64("text")))


def _sketched(rows: DataFrame) -> DataFrame:
    """(tid, n, buckets) of all texts with a word, n shingles each, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            done = 0
            tids = batch.column(0)
            for words, n in _word_rows(batch.column(1).to_pylist()):
                sh, m = shingles(words, n)
                out = sketches(sh, m).view(np.int64)
                some = np.flatnonzero(m > 0)
                keys = list(out[some])
                at, end = np.cumsum(m) - m, np.cumsum(n)
                for i in np.flatnonzero(m[some] <= SHORT):
                    d = some[i]
                    short = short_keys(sh[at[d] : at[d] + m[d]], words[end[d] - n[d] : end[d]])
                    keys[i] = np.unique(np.concatenate([keys[i], np.array(short, np.uint64).view(np.int64)]))
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        tids.slice(done, len(n)).take(pa.array(some)),
                        pa.array(m[some].astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, flat),
                    ],
                    names=["tid", "n", "buckets"],
                )
                done += len(n)

    texts = rows.filter(F.col("tid").isNotNull()).select("tid", "text")
    return staged(texts.mapInArrow(run, "tid long, n int, buckets array<long>").dropDuplicates(["tid"]), "omh-sketches")


def _word_sequences(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(tid, words, profile) of the texts to compare: word hashes, four bytes
    each, and the number of labelled shingles by cell, one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            done = 0
            for words, n in _word_rows(batch.column(1).to_pylist()):
                low = words.astype("<u4")
                ends = np.cumsum(n)
                sh, m = shingles(low.astype(np.uint64), n)
                cell = np.repeat(np.arange(len(n)), m) * CELLS + (labelled(sh, m) % np.uint64(CELLS)).astype(np.int64)
                profile = np.bincount(cell, minlength=len(n) * CELLS).clip(max=255).astype(np.uint8).reshape(-1, CELLS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(n)),
                        pa.array([low[e - k : e].tobytes() for e, k in zip(ends, n)], pa.binary()),
                        pa.array([x.tobytes() for x in profile], pa.binary()),
                    ],
                    names=["tid", "words", "profile"],
                )
                done += len(n)

    # by shuffle at every size: the needed ids grow with the corpus
    texts = rows.select("tid", "text").join(needed.hint("merge"), "tid", "left_semi").dropDuplicates(["tid"])
    return texts.mapInArrow(run, "tid long, words binary, profile binary")


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``least``."""
    both = (
        pairs.join(words.select(F.col("tid").alias("a"), F.col("words").alias("wa")), "a")
        .join(words.select(F.col("tid").alias("b"), F.col("words").alias("wb")), "b")
        .select("a", "b", "wa", "wb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            got = [
                similarity(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4"), least)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            rows = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["a", "b", "similarity"]
            )
            yield rows.filter(pa.array([s >= least for s in got], pa.bool_()))

    return both.mapInArrow(run, "a long, b long, similarity double")


def _with_top(met: DataFrame, least: float) -> DataFrame:
    """(a, b): each member with its bucket's hub, if their lengths allow it."""
    hubs = met.filter("hub").select("bucket", F.col("tid").alias("h"), F.col("n").alias("h_n"))
    alike = (F.col("tid") != F.col("h")) & (F.least("n", "h_n") >= F.lit(least) * F.greatest("n", "h_n"))
    return met.join(hubs, "bucket").filter(alike).select(F.least("h", "tid").alias("a"), F.greatest("h", "tid").alias("b"))


def _possible(met: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(a, b): members with hubs of their bucket that are of another component
    and whose profiles allow the similarity."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (
        met.join(words.select("tid", "profile"), "tid")
        .withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("tid"), blocks).cast("int")})
        .select("bucket", "blocks", "block", "hub", F.struct("tid", "n", "root", "profile").alias("one"))
    )
    placed = staged(placed, "omh-placed")
    # bounded: BLOCK members of a bucket on average
    left = placed.groupBy("bucket", "block").agg(F.collect_list("one").alias("members"))
    # every block of hubs goes to every block of members: no bucket is one task
    right = (
        placed.filter("hub")
        .groupBy("bucket", F.col("block").alias("h_block"))
        .agg(F.first("blocks").alias("blocks"), F.collect_list("one").alias("hubs"))
        .select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "hubs")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()

        def columns(x: pa.ListScalar) -> list[np.ndarray]:
            v = x.values
            flat = np.frombuffer(b"".join(v.field("profile").to_pylist()), np.uint8).reshape(-1, CELLS)
            return [np.asarray(v.field(c)) for c in ("tid", "n", "root")] + [flat.astype(np.int16)]

        for batch in batches:
            for members, hubs in zip(batch.column(0), batch.column(1)):
                tid, n, root, profile = columns(members)
                out = []
                for h, h_n, h_root, h_profile in zip(*columns(hubs)):
                    at = np.flatnonzero((root != h_root) & (np.minimum(n, h_n) >= least * np.maximum(n, h_n)))
                    apart = np.abs(profile[at] - h_profile).sum(axis=1, dtype=np.int64)
                    near = tid[at[apart <= (n[at] + int(h_n)) * (1 - least) / (1 + least) + 1e-6]]
                    out.append(np.stack([np.minimum(near, h), np.maximum(near, h)]))
                a, b = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return left.join(right, ["bucket", "block"]).select("members", "hubs").mapInArrow(run, "a long, b long")


def links(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b, similarity), a < b, between different texts, that
    join all candidates of similarity ``least`` or more; ``rows`` has tid and
    text."""
    every = _sketched(rows).select("tid", "n", F.explode("buckets").alias("bucket"))
    sizes = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = staged(every.join(sizes, "bucket"), "omh-shared")
    central = shared.groupBy("tid").agg(F.sum("size").alias("central"))
    members = staged(
        shared.join(central, "tid").select("bucket", "tid", "n", "central", F.col("tid").alias("root")), "omh-members"
    )
    words = staged(_word_sequences(rows, members.select("tid").distinct()), "omh-words")
    parts, tried, turn, more = [], None, 0, 0
    while True:
        untried = (
            members.groupBy("bucket")
            .agg(
                F.max(F.struct("central", "tid")).alias("top"),
                F.count(F.lit(1)).alias("size"),
                F.min("root").alias("low"),
                F.max("root").alias("high"),
            )
            .filter("low < high")
            .select("bucket", F.col("top.tid").alias("top"), "size")
        )
        drawn = F.pmod(F.xxhash64("bucket", "tid"), F.lit(1 << 20)) * F.col("size") < F.lit(more << 20)
        met = staged(
            members.join(untried, "bucket").select(
                "bucket", "tid", "n", "central", "root", "size", ((F.col("tid") == F.col("top")) | drawn).alias("hub")
            ),
            f"omh-met-{turn}",
        )
        if not met.take(1):
            break
        pairs = (_possible(met, words, least) if turn else _with_top(met, least)).distinct()
        if parts:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, f"omh-pairs-{turn}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        part = staged(_verified(pairs, words, least), f"omh-links-{turn}")
        parts.append(part)
        rest = met.filter("not hub").drop("hub", "size")
        if part.take(1):
            roots = components(reduce(DataFrame.unionByName, parts)).withColumnRenamed("root", "now")
            rest = rest.join(roots, "tid", "left").withColumn("root", F.coalesce("now", "root"))
        members = staged(rest.select("bucket", "tid", "n", "central", "root"), f"omh-members-{turn}")
        turn, more = turn + 1, max(1, more) * GROWTH
    none = rows.sparkSession.createDataFrame([], "a long, b long, similarity double")
    return reduce(DataFrame.unionByName, parts) if parts else none


def components(edges: DataFrame, max_steps: int = 50) -> DataFrame:
    """(tid, root): smallest text hash of each connected component, by
    passing minima to neighbours and jumping to the root's root."""
    both = staged(
        edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
        .distinct(),
        "omh-edges",
    )
    roots = both.groupBy(F.col("u").alias("tid")).agg(F.min("v").alias("near")).select("tid", F.least("tid", "near").alias("root"))
    roots = staged(roots, "omh-roots")
    for _ in range(max_steps):
        told = (
            both.join(roots.select(F.col("tid").alias("v"), F.col("root").alias("r")), "v")
            .groupBy(F.col("u").alias("tid"))
            .agg(F.min("r").alias("r"))
        )
        lower = roots.join(told, "tid").select("tid", "root", F.least("root", "r").alias("new"))
        jump = roots.select(F.col("tid").alias("new"), F.col("root").alias("far"))
        after = staged(
            lower.join(jump, "new").select("tid", "root", F.least("new", "far").alias("next")), "omh-roots"
        )
        roots = after.select("tid", F.col("next").alias("root"))
        if not after.filter("next < root").take(1):
            return roots
    raise RuntimeError("components did not settle")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, tid, class_id (smallest id of the class),
    class_size, n_links (verified links of its text to other texts), is_first
    (the row, or repeats of the row, that stands for the class)."""
    rows = _text_id(docs.select("doc_id", "text"))
    found = staged(links(rows, least), "omh-links")
    roots = components(found)
    degree = (
        found.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("n_links"))
    )
    named = (
        rows.select("doc_id", "tid")
        .join(roots.join(degree, "tid"), "tid", "left")
        .select("doc_id", "tid", F.coalesce("root", "tid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    named = staged(named, "omh-named")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")
    sizes = (
        named.filter(F.col("root").isNotNull())
        .groupBy("root")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("class_size"))
    )
    return named.join(sizes, "root", "left").select(
        "doc_id",
        "tid",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.col("n_links").cast("long").alias("n_links"),
        (F.col("root").isNull() | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tid") == F.col("tid")))).alias(
            "is_first"
        ),
    )


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` without near copies: of each class the row of its smallest id
    stays, once; rows with a null text all stay."""
    named = classes(docs, least)
    kept = named.filter(F.col("tid").isNotNull() & F.col("is_first")).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__omh_id"), F.col("tid").alias("__omh_tid")
    )
    keyed = docs.withColumns(
        {"__omh_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__omh_tid": F.xxhash64("text")}
    )
    stay = (
        keyed.filter(F.col("text").isNotNull())
        .join(kept.distinct(), ["__omh_id", "__omh_tid"])
        .dropDuplicates(["__omh_id", "__omh_tid"])
        .select(*docs.columns)
    )
    return stay.unionByName(docs.filter(F.col("text").isNull()))
