import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from tessera.llm import order_minhash as om
from tessera.llm.common import hash_words


def edited(words, rng, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append("edit%d" % rng.randrange(10**6) if r < rate else w)
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def exact(a, b):
    """Similarity by the whole table of the longest common subsequence."""
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    x, y = sh(a.lower().split()), sh(b.lower().split())
    m = lcs(x, y)
    return m / (len(x) + len(y) - m) if x and y else 0.0


def word_hashes(text):
    return hash_words([text])[0].astype(np.uint32)


def test_similarity_matches_the_full_table():
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(40)]
    for _ in range(250):
        a = [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]
        b = edited(a, rng, rng.choice([0, 0.01, 0.03, 0.06]))
        if rng.random() < 0.3:
            k = rng.randrange(len(b) + 1)
            b = b[k:] + b[:k]
        a, b = " ".join(a), " ".join(b)
        want = exact(a, b)
        got = om.similarity(word_hashes(a), word_hashes(b))
        assert got == pytest.approx(want if want >= 0.8 else 0.0), (a, b)


def test_banded_alignment_with_a_wide_band():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 30))
        assert om.banded_alignment(a, b, 40) == lcs(a.tolist(), b.tolist())


def test_sketch_keeps_order_and_counts_repeats():
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words), " ".join(words[150:] + words[:150]), " ".join(words[:150] * 2), "a b", ""]
    h, n = hash_words(texts)
    s = om.sketches(*om.shingles(h, n))
    assert (s[0] == s[1]).all() and (s[0] != s[3]).all() and (s[5] == 0).all() and (s[4] != 0).all()
    assert 0 < (s[0] == s[2]).sum() < om.SKETCHES  # same shingles, other order


def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = some(120)
    texts, group = [], []
    for g in range(120):
        base = some(rng.randrange(40, 400))
        if g % 4 == 0:  # many texts share a passage
            base = base[:150] + passage + some(60)
        for k in range(rng.choice([1, 1, 2, 5])):
            words = base if k == 0 else edited(base, rng, 0.01)
            texts.append(" ".join(words))
            group.append(g)
    return texts, group


def test_classes_are_those_of_brute_force(spark):
    texts, _ = corpus()
    texts += texts[:10] + ["", "", "one two", "One  two", "one three", None, None, "x " * 50, "x " * 51, "y " * 9000]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, tid int")
    got = {r.doc_id: r for r in om.classes(docs).collect()}
    parent = ids.copy()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [set(zip(*[(t or "").lower().split()[k:] for k in range(5)])) for t in texts]
    for i in ids:
        for j in ids[:i]:
            if texts[i] is None or texts[j] is None:
                continue
            close = texts[i] == texts[j]
            if not close and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]):
                close = exact(texts[i], texts[j]) >= 0.8
            if not close and (texts[i] or "").lower().split() == (texts[j] or "").lower().split() != []:
                close = True
            if close:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: got[i].class_id for i in ids} == {i: root(i) for i in ids}
    assert all(got[i].class_size == sum(root(j) == root(i) for j in ids) for i in ids)
    kept = om.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(i) for i in ids})


def test_a_large_group_of_copies_and_a_shared_passage(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(300)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(150)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    share = [passage + " " + " ".join(rng.choice(vocab) for _ in range(60)) for _ in range(150)]
    texts = [" ".join(base)] * 100 + near + share
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = om.classes(docs).collect()
    assert {r.class_id for r in got if r.doc_id < 250} == {0}
    assert all(r.class_id == r.doc_id for r in got if r.doc_id >= 250)


@pytest.mark.parametrize("changes", [4, 5])
def test_a_large_group_without_a_center(spark, changes):
    """Copies that lost their original: most pairs are below 0.8, the links
    run through many texts, and no few hubs see them all."""
    rng = random.Random(changes)
    base = [f"v{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for i in range(160):
        words = base.copy()
        for k in rng.sample(range(300), changes):
            words[k] = f"new{i}x{k}"
        texts.append(" ".join(words))
    hashes = [word_hashes(t) for t in texts]
    sketch = [set(om.sketches(*om.shingles(h.astype(np.uint64), np.array([300])))[0].tolist()) for h in [hash_words([t])[0] for t in texts]]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sketch[i] & sketch[j] and root(i) != root(j) and om.similarity(hashes[i], hashes[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in om.classes(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_short_texts_are_never_missed(spark):
    """One word more at an end, for every length up to 22 words; and texts
    whose repeated words leave shingles unmatched in the middle."""
    texts, want = [], []
    for n in range(8, 23):
        words = [f"n{n}w{k}" for k in range(n)]
        for case in range(6):
            one = [f"{case}{w}" for w in words]
            pair = [one, one + ["more"]] if case % 2 else [one, ["more", *one]]
            want += [len(texts)] * 2
            texts += [" ".join(p) for p in pair]
    for a, b in (("a b c d x y y y y z e f g h", "a b c d x y y y y y z e f g h"), ("p q r p q r p q r p q r", "p q r p q r p q r p q r p q")):
        want += [len(texts), len(texts) if exact(a, b) >= 0.8 else len(texts) + 1]
        texts += [a, b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.class_id for r in om.classes(docs).orderBy("doc_id").collect()] == want


def test_short_keys_meet_whenever_similar():
    rng = random.Random(5)
    met = 0
    for _ in range(4000):
        a = [rng.choice("ab" if rng.random() < 0.5 else "abcdefghijkl") for _ in range(rng.randrange(6, 23))]
        b = a.copy()
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.choice("ab")] * rng.randrange(2)
        texts = [" ".join(a), " ".join(b)]
        h, n = hash_words(texts)
        sh, m = om.shingles(h, n)
        if m.max() <= om.SHORT and exact(*texts) >= 0.8:
            keys = [om.short_keys(s, w) for s, w in zip(np.split(sh, m[:1]), np.split(h, n[:1]))]
            assert set(keys[0]) & set(keys[1]), texts
            met += texts[0] != texts[1]
    assert met > 100


def test_empty_tables_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert om.classes(spark.createDataFrame([], schema)).count() == 0
    assert om.keep_one(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (None, "lonely words"), (4, None), (4, None)], schema)
    assert sorted(map(str, (r.class_id for r in om.classes(docs).collect()))) == ["4", "4", "5", "5", "5", "None"]
    assert sorted(map(str, (r.doc_id for r in om.keep_one(docs).collect()))) == ["4", "4", "5", "None"]


def test_difflib_agrees_on_single_edits():
    a = [f"w{i}" for i in range(100)]
    b = a[:50] + ["x"] + a[51:]
    assert SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.98
    assert om.similarity(word_hashes(" ".join(a)), word_hashes(" ".join(b))) == pytest.approx(91 / 101)
