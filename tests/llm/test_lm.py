import random
import re
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

from tessera.llm import lm

FOLDS, HELD = 5, 1


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def brute(rows, masses):
    """Counts in dictionaries; a walk that carries the state through arcs and failure arcs."""
    order = len(masses) + 1
    held = [crc32(str(i if i is not None else "").encode()) % FOLDS == HELD for i, _ in rows]
    count = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            w = ["<s>"] * (order - 1) + words(t)
            for k in range(1, order):
                count[("<s>",) * k] += 1
            for i in range(order - 1, len(w)):
                for k in range(order):
                    count[tuple(w[i - k : i + 1])] += 1
    single = {g[0]: c for g, c in count.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(single.values()), len(single)
    p1 = lambda w: (single.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))

    def weight(w, h):
        """Arc weight of w in the state h, failure arcs included."""
        if not h:
            return p1(w)
        mass = masses[len(h) - 1]
        if not count[h + (w,)]:
            return mass / (count[h] + mass) * weight(w, h[1:])
        return (count[h + (w,)] + mass * weight(w, h[1:])) / (count[h] + mass)

    def walk(w):
        state, total = ("<s>",) * (order - 1), 0.0
        for x in w:
            while state and not count[state]:
                state = state[1:]  # a context that was not seen is no state
            total += log10(weight(x, state))
            state = (state + (x,))[-(order - 1) :] if order > 1 else ()
        return total

    if n:  # in every state the words seen and an unseen one have probability 1
        ends = {g[:-1] for g, c in count.items() if c and g[-1] != "<s>"}
        for h in ends:
            assert sum(weight(w, h) for w in single) + weight("never", h) == pytest.approx(1)

    out = []
    for (i, t), h in zip(rows, held):
        w = words(t)
        model = walk(w)
        out.append((str(i), h, len(w), sum(x in single for x in w), n, sum(log10(p1(x)) for x in w), model))
    return sorted(out)


@pytest.mark.parametrize("masses, chunk", [((), 1 << 20), ((3.0,), 700), ((9.0, 2.0), 1 << 20), ((9.0, 2.0), 1500), ((3.0, 2.0, 1.0), 3000)])
def test_scores_match_brute_force(spark, masses, chunk):
    rng = random.Random(len(masses))
    vocab = ["a", "B", "b", "É", "é", "xx", "yy,", "日本", "\u0085"]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(vocab) for _ in range(rng.randrange(25)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t"), (None, "a b"), (3, rows[3][1]), (3, rows[3][1]), (600, "a b " * 3000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        for r in lm.score(docs, masses=masses, chunk_bytes=chunk).collect()
    )
    want = brute(rows, masses)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty_table_and_no_training_rows(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(50) if crc32(str(i).encode()) % FOLDS == HELD)
    row = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.n_tokens == 3
    assert row.score == row.base_score == 0.0  # one unseen word, probability 1


def test_keys_survive_packing():
    rng = np.random.default_rng(5)
    for n, bits in ((0, 62), (1, 62), (5, 40), (3000, 48), (3000, 62)):
        keys = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
        assert (lm._unpacked_keys(lm._packed_keys(keys)) == keys).all()
        assert (keys[lm._find(keys, keys[::-1], bits)] == keys[::-1]).all()
        assert (lm._unpacked(lm._packed(keys)) == keys).all()
    zero = np.zeros(1, np.uint64)
    assert (lm._unpacked_keys(lm._packed_keys(zero)) == zero).all()


def test_a_failure_weight_belongs_to_its_state(spark):
    """A word not seen after a context costs more the better the context is known."""
    train = [i for i in range(400) if crc32(str(i).encode()) % FOLDS != HELD]
    held = [i for i in range(400) if crc32(str(i).encode()) % FOLDS == HELD]
    rows = [(i, "rare x" if k == 0 else "often y") for k, i in enumerate(train)]
    rows += [(held[0], "rare z"), (held[1], "often z"), (held[2], "z rare q"), (held[3], "z often q")]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), masses=(10.0,)).collect()}
    lost = lambda i: got[i].score - got[i].base_score
    assert lost(held[3]) - lost(held[2]) < -1  # log10 (mass / (mass + c))
