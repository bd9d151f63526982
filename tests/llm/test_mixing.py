import random

import pytest

from tessera.llm import mixing


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Water filling as it is told: share, cut at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        out = {s: cap * sizes[s] if s in full else left * w[s] / sum(w[o] for o in open_) for s in names}
        above = {s for s in open_ if out[s] > cap * sizes[s] + 1e-9}
        if not above:
            return out
        full |= above


def words(n):
    return " ".join(["w"] * n) if n else None


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_budgets(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", None, "zz", "src0"][: rng.randrange(2, 7)]
    rows = [(i, rng.choice(names + names[:1] * 6), rng.randrange(0, 40)) for i in range(300)]
    rows += rows[:5] + [(None, names[0], 7), (None, names[0], 7)]
    docs = spark.createDataFrame([(i, s, words(n), 1) for i, s, n in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert sum(r.taken for r in mine) == int(mine[0].target + 1e-9)
        assert all(r.size * r.epochs <= r.taken <= min(3 * r.size, (r.epochs + 1) * r.size) for r in mine)


def test_empty_and_all_empty_texts(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
