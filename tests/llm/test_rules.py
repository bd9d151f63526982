import random
import re

import numpy as np

from tessera.llm import rules
from tessera.llm.common import labelled_sample


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    cover = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n_symbols = len(re.findall(r"[#*$%&|<>]", text))
    return [len(words), sum(map(len, words)), n_symbols, dup, len(cover)]


def random_text(rng):
    words = [rng.choice(["a", "bb", "é", "#x", "日本", "\u0085", "<", "c" * 30]) for _ in range(rng.randrange(80))]
    return "".join(w + rng.choice([" ", " ", "\n", "\t", "\r\n", "  ", "\x0b"]) for w in words)


def test_counts_match_brute_force():
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(300)]
    texts += [None, "", " ", "\n\n", "a", "a " * 9, "a " * 8, "x\n" * 40, "line one\nline one\n line one\n", "w " * 60_000]
    counts, _ = rules.figures(texts)
    assert counts.tolist() == [brute(t) for t in texts]
    assert rules.figures([])[0].shape == (0, 5)


def frame(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30, 200))]
        good = int(rng.random() < 0.8)
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words), good))
    docs = spark.createDataFrame([(i, t, True, 0.0) for i, t, _ in rows], "doc_id long, text string, kept boolean, anomaly double")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), rows


def test_anomalies_go_and_clean_rows_stay(spark):
    docs, labels, _ = frame(spark, 500, 1)
    forest = rules.learn(docs, labels)
    other, _, rows = frame(spark, 300, 2)
    kept = {r.doc_id: r.kept for r in rules.judge(other, forest).collect()}
    assert sum(kept[i] != bool(y) for i, _, y in rows) <= 4


def test_defined_results(spark):
    docs, labels, _ = frame(spark, 200, 1)
    forest = rules.learn(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "word"), (4, "again " * 50)], "doc_id long, text string")
    for known in (forest, None):
        got = rules.judge(odd, known).collect()
        assert len(got) == 5 and all(r.base_failed and not r.kept for r in got)
    assert rules.judge(odd.limit(0), forest).count() == 0
    assert rules.learn(docs, labels.limit(0)) is None
    assert all(r.kept for r in rules.judge(docs, None).collect())


def test_path_lengths_isolate_an_outlier():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * 0.1
    forest = rules.grow(x, np.vstack([x, [[5.0, 5.0, 5.0]]]))
    s = forest.score(np.vstack([x, [[5.0, 5.0, 5.0]]]))
    assert s[-1] > s[:-1].max() and (0 < s).all() and (s <= 1).all()


def test_every_labelled_row_counts(spark):
    """20,000 labelled rows, of which the last 30 are bad: a fit on a part of
    them (it was 10,000) sees another number of rows, and at another loss."""
    good = " ".join(f"w{i}" for i in range(40))
    bad = " ".join(f"w{i}###" for i in range(40))
    n, odd = 20_000, 30
    docs = spark.range(n).selectExpr("id AS doc_id", f"IF(id < {n - odd}, '{good}', '{bad}') AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", f"CAST(id < {n - odd} AS int) AS quality")
    rows = rules.labelled_figures(docs, labels, "quality")
    assert {r.good: r["count"] for r in rows.groupBy("good").count().collect()} == {True: n - odd, False: odd}
    kept = rules.judge(docs, rules.learn(docs, labels)).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in kept} == {True: n - odd, False: odd}


def test_one_good_row_among_many_keeps_its_place(spark):
    """Documents of one odd kind are label 1, but for few; losing none of
    label 1 must hold for all rows, also for a single one."""
    texts = {0: " ".join(f"w{i}" for i in range(40)), 1: " ".join(f"w{i}###" for i in range(40))}
    n = 15_000
    docs = spark.range(n).selectExpr("id AS doc_id", f"IF(id % 100 = 0, '{texts[1]}', '{texts[0]}') AS text")
    chosen = spark.range(n).selectExpr("id AS doc_id", "IF(id % 100 = 0, 0, 1) AS quality")
    seen = {r.doc_id for r in labelled_sample(docs, chosen, "quality", 1, -1, 10_000).select("doc_id").collect()}
    unseen = next(i for i in range(0, n, 100) if i not in seen)
    labels = chosen.selectExpr("doc_id", f"IF(doc_id = {unseen}, 1, quality) AS quality")
    kept = rules.judge(docs, rules.learn(docs, labels, max_loss=0.0))
    assert kept.filter("NOT kept").count() == 0


def test_threshold_equals_a_scan_of_the_sorted_scores(spark):
    rng = np.random.default_rng(5)
    for trial in range(4):
        score = np.round(rng.beta(2 + 3 * (rng.random(3000) < 0.2), 4), [9, 2, 9, 4][trial])
        good = rng.random(3000) > score
        frame_ = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good)], "score double, good boolean")
        cuts = np.unique(score)
        lost = np.array([1 - (score[good] <= c).sum() / good.sum() for c in cuts])
        caught = np.array([1 - (score[~good] <= c).sum() / (~good).sum() for c in cuts])
        loss = [0.002, 0.3, 0.5, 0.05][trial]
        best = int(np.argmax(np.where(lost <= loss, caught - lost, -np.inf)))
        assert rules.threshold(frame_, loss) == cuts[[best, min(best + 1, len(cuts) - 1)]].sum() / 2
    assert rules.threshold(frame_.filter("good"), 0.1) == rules.threshold(frame_.limit(0), 0.1) == float("inf")


def test_masses_of_all_rows_give_the_path_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 3))
    forest = rules.grow(x[:600], x)
    masses = forest.masses(x)
    assert (masses.sum(1) == 5000).all() and (masses[forest.feature >= 0] == 0).all()
    forest.weigh(masses, 5000)
    node = next(forest.leaves(x[:1]))[0]
    mean = masses[0, node] * 256 / 5000
    assert forest.path[0, node] == forest.depth[0, node] + float(rules._expected(mean))
    assert np.allclose(rules._expected([1, 2]), [0, 1]) and (np.diff(rules._expected(np.linspace(0, 9, 500))) >= -1e-12).all()
