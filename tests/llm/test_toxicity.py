import random

import pytest

from tessera.llm import toxicity as tox


def texts(n, seed, stem="grukvor"):
    """Invented rows: label 1 holds 'badword' or a stem with a changing ending."""
    rng = random.Random(seed)
    vocab = [rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdfgklmnprst") + rng.choice(["", "a", "en"]) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["badword", stem + rng.choice(vocab)]))
        elif rng.random() < 0.3:
            at = rng.randrange(len(words))
            words[at:at] = ["anti", "badword"]
        rows.append((i, " ".join(words), y))
    return rows


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = texts(900, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    return tox.learn(docs, labels)


def score(spark, lexicon, *rows):
    docs = spark.createDataFrame(
        [(i, t, "x", 9.0) for i, t in enumerate(rows)], "doc_id long, text string, hits string, score double"
    )
    return [r.score for r in tox.score_texts(docs, lexicon).orderBy("doc_id").collect()]


def test_learned_terms(lexicon):
    assert any("badword".startswith(t.strip()) for t in lexicon.terms)
    assert any("grukvor".startswith(t.strip()) for t in lexicon.terms)
    assert " anti badword " in lexicon.exceptions


def test_held_out_rows(spark, lexicon):
    rows = texts(300, 99)
    got = score(spark, lexicon, *[t for _, t, _ in rows])
    wrong = sum((s >= 0.3) != bool(y) for s, (_, _, y) in zip(got, rows))
    assert wrong <= 3


def test_folding_and_exceptions(spark, lexicon):
    filler = "kan tib lorema sen dit "
    clean, *toxic = score(
        spark,
        lexicon,
        filler * 5,
        filler + "BADWORD!!",
        filler + "b4dw0rd",
        filler + "bаdwоrd",  # Cyrillic letters
        filler + "ｂａｄｗｏｒｄ",
        filler + "bád\u200bwörd",
        filler + "b a d w o r d",
        filler + "b.a.d.w.o.r.d",
        filler + "grukvorneverseen",
    )
    assert clean < 0.3
    assert min(toxic) >= 0.3, toxic
    assert score(spark, lexicon, filler * 5 + "anti badword")[0] == pytest.approx(clean, abs=0.05)


def test_length_lowers_the_score(spark, lexicon):
    short, long = score(spark, lexicon, "badword", "badword " + "kan tib " * 20000)
    assert long <= short


def test_empty_null_and_no_labels(spark, lexicon):
    empty, null, blank = score(spark, lexicon, "", None, " \n ")
    assert empty == null == blank and 0 <= empty < 0.3
    docs = spark.createDataFrame([(1, "badword")], "doc_id long, text string")
    none = tox.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.terms == {} and score(spark, none, "badword", None) == [0.0, 0.0]
    assert tox.score_texts(docs.limit(0), lexicon).count() == 0


def test_fold_by_hand():
    assert tox.fold(None) == tox.fold("") == tox.fold("  ") == " "
    assert tox.fold("One, two!!  (three)") == " one two three "
    assert "loser" in tox.plain_forms("1o5er") and "idiot" in tox.plain_forms("1d10t!!")


def test_combined_disguises(spark, lexicon):
    filler = "kan tib lorema sen dit "
    forms = ["b 4 d w 0 r d", "b.4.d.w.0.r.d", "b-а-d-w-о-r-d", "bad-word", "b4d_w0rd", "ｂ 4 ｄ ｗ 0 ｒ ｄ", "b.á.d.w.ö.r.d!!"]
    got = score(spark, lexicon, *[filler + f for f in forms])
    assert min(got) >= 0.3, dict(zip(forms, got))


def test_words_of_any_length_are_matched(spark, lexicon):
    long = "x" * 50_000
    got = score(spark, lexicon, f"kan {long} badword {long}", f"kan {long} {long}")
    assert got[0] >= 0.3 > got[1]


@pytest.mark.parametrize("seed", range(3))
def test_automaton_agrees_with_a_naive_scan(seed):
    """Of the terms that begin at a word the longest decides, outside of
    exception phrases; found by trying all terms at all places."""
    rng = random.Random(seed)
    for _ in range(300):
        word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
        terms = {f" {word()}" + rng.choice(["", " "]): rng.choice([0.0, 1.0, 2.5]) for _ in range(8)}
        exceptions = tuple({f" {word()} {word()} " for _ in range(3)})
        lex = tox.Lexicon(terms, exceptions)
        text = " " + " ".join(word() for _ in range(30)) + " "
        spared = [(i, i + len(e)) for e in exceptions for i in range(len(text)) if text.startswith(e, i)]
        want = []
        for i in range(len(text)):
            here = [t for t in terms if t not in exceptions and text.startswith(t, i)]
            if here:
                best = max(here, key=len)
                if terms[best] > 0 and not any(a <= i and i + len(best) <= b for a, b in spared):
                    want.append((i, i + len(best), terms[best]))
        assert tox.hits(text, lex.matcher()) == want


def test_empty_table(spark, lexicon):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tox.without_toxic(empty, lexicon).collect() == []
    none = tox.learn(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert none.terms == {} and none.exceptions == ()
