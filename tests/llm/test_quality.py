import random

import numpy as np

from tessera.llm import quality as q


def rows(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(10, 200))]
        y = int(rng.random() < 0.7)
        if not y:
            kind = rng.randrange(3)
            words = [w + "###" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else words[:1] * 40
        out.append((i, " ".join(words), y))
    return out


def frame(spark, data):
    docs = spark.createDataFrame([(i, t, 5.0) for i, t, _ in data], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(0, None)], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy(spark):
    train, test = rows(600, 1), rows(300, 2)
    model = q.learn(*frame(spark, train))
    got = {r.doc_id: r.score for r in q.score_texts(frame(spark, test)[0], model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == bool(y) for i, _, y in test) >= 290


def test_defined_results(spark):
    model = q.learn(*frame(spark, rows(300, 1)))
    odd = [(0, None, 0), (1, "", 0), (2, " \n", 0), (3, "same text", 0), (3, "same text", 0), (None, "word " * 100_000, 0)]
    got = sorted((str(r.doc_id), r.score) for r in q.score_texts(frame(spark, odd)[0], model).collect())
    assert len(got) == 6 and got[0][1] == got[1][1] == got[2][1] and got[3][1] == got[4][1]
    assert q.score_texts(frame(spark, odd)[0].limit(0), model).count() == 0
    none = q.learn(frame(spark, odd)[0], spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in q.score_texts(frame(spark, odd)[0], none).collect()} == {0.0}


def test_descent_reaches_the_optimum():
    """The dual solution satisfies the optimality conditions of the machine."""
    rng = np.random.default_rng(0)
    rows_, y = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)], rng.integers(0, 2, 80).astype(float)
    values = [rng.normal(size=6) for _ in rows_]
    w = q.dual_coordinate_descent(rows_, values, y, 30, 0.5, 3000)

    def loss(w):
        share = (y > 0).mean()
        cost = np.where(y > 0, 0.25 / share, 0.25 / (1 - share))
        margin = np.array([(1 if t else -1) * (w[x] @ v + w[30]) for x, v, t in zip(rows_, values, y)])
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - margin)).sum()

    best = loss(w)
    for _ in range(300):
        assert loss(w + rng.normal(size=31) * 10 ** rng.uniform(-4, 0)) >= best * (1 - 1e-3)
