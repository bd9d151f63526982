import hashlib
import random
import re

import pytest

from tessera.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in RAW.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


PARTS = [
    "a@b.c", "x.y+z@mail-7.example.com.", "@", "a@@b.c", "a@b.c@d.e.f", "a@b.c+d@e.f", "%@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1",
    "000255.01.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111112", "4111  1111 1111 1111", "79927398713",
    "+1 (377) 555-0271", "+1", "+12345678", "+123456789", "+1 2 3 (4) 5.6-7 8 9 --", "é", "日本", "\U0001f600", ".", "-", "7", "0" * 15,
]


def detect(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    return {r.doc_id: r for r in pii.detect(docs, **more).collect()}


def test_base_spans_match_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", "\n", "x"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    texts += [None, "", "1" * 30_000, "1 " * 30_000, "a" * 50_000 + "@", "1.2.3.4 " * 500, "+" + "1 " * 5_000]
    got = detect(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i].base] == brute(t), repr(t)[:200]


@pytest.fixture(scope="module")
def corpus():
    """'zephyrine' stands only beside one address, in different contexts;
    'common' stands everywhere; copies of one text name 'copyword'."""
    rng = random.Random(3)
    vocab = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [f"{some(30)} Zephyrine common secret@person.example.org {some(30)}" for _ in range(6)]
    texts += [f"common {some(60)} common" for _ in range(300)]
    texts += [f"{some(20)} copyword other@place.example.org {some(3)}"] * 20
    edited = some(24).split()  # edited copies of one text
    for k in range(12, 24):
        texts.append(" ".join([*edited[:14], "copied@place.example.org", *edited[14:k], "changed%d" % k, *edited[k + 1 :]]))
    texts += [f"zephyrine alone {some(10)}", f"no word near secret@person.example.org {some(40)} ZEPHYRINE"]
    return texts


def test_disclosing_terms(spark, corpus):
    got = detect(spark, corpus)
    for i, t in enumerate(corpus):
        want = [m.span() for m in re.finditer("zephyrine", t, re.I)] if "secret@" in t else []
        assert [(s.start, s.end) for s in got[i].terms] == want, t


def test_sanitized_texts(spark, corpus):
    docs = spark.createDataFrame([(i, t, 0, None) for i, t in enumerate([*corpus, None, ""])], "doc_id long, text string, n_chars int, __x string")
    rows = {r.doc_id: r for r in pii.sanitize(docs).collect()}
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {"doc_id", "text", "n_chars", "__x"}
    assert "@" not in rows[0].text and "<EMAIL>" in rows[0].text and "ephyrine" not in rows[0].text
    assert rows[10].text == corpus[10] and rows[10].n_chars == len(corpus[10])
    assert rows[len(corpus)].text is None and rows[len(corpus) + 1].text == ""


def test_query_digest_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(empty).count() == 0 and pii.sanitize(empty).count() == 0
    got = detect(spark, ["mail a@b.c now"])[0]
    assert hashlib.sha256(b"email:5:10").hexdigest() and [tuple(s)[:3] for s in got.base] == [("email", 5, 10)]


def plain_terms(texts, threshold=0.4):
    """(entity, term) by brute force over different texts without near copies."""
    import math

    texts = sorted({t or "" for t in texts})
    docs, beside = {}, {}
    for n, t in enumerate(texts):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        for k, a, b in brute(t):
            entity = (k, re.sub("[^0-9]", "", t[a:b]) if k in ("card", "phone") else t[a:b].lower())
            docs.setdefault(entity, set()).add(n)
            near = [w for _, e, w in words if e <= a][-5:] + [w for s, _, w in words if s >= b][:5]
            for term in {x for w in near for x in re.findall(r"[^\W_]+", w.lower())}:
                beside.setdefault((entity, term), set()).add(n)
    m = len(texts)
    out = set()
    for (entity, term), of in beside.items():
        n_e, n_et = len(docs[entity]), len(of)
        cf = sum(term in re.findall(r"[^\W_]+", t.lower()) for t in texts)
        least = min(n_e, cf)
        share = math.log(n_et * m / (n_e * cf)) / math.log(m / n_e) * n_et / (n_et + 1) * least / (least + 1)
        if share >= threshold:
            out.add((":".join(entity), term))
    return out


def test_terms_against_brute_force(spark):
    """Numeric, two-letter and very long terms; a fixed signature; one, two
    and many documents."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    some = lambda n: " ".join(word() for _ in range(n))
    long = "x" * 500
    texts = [f"{some(40)}" for _ in range(200)]
    texts += [f"{some(20)} 7741 li a.b@c.org {some(20)}" for _ in range(8)]
    texts += [f"{some(20)} {long} +1 377 555 0271 {some(20)}" for _ in range(4)]
    texts += [f"{some(20)} best wishes from our house 10.1.2.3 in the old town {some(20)}" for _ in range(5)]
    texts += [f"{some(20)} once one@time.org {some(20)}", f"{some(9)} twin tw@in.org {some(9)}", f"{some(9)} twin tw@in.org {some(9)}"]
    texts += [f"{some(9)} li {some(9)}" for _ in range(3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:30]])], "doc_id long, text string")
    found = pii.find(docs)
    got = {(r.entity, r.term) for r in pii.disclosing_terms(docs, found).collect()}
    assert got == plain_terms(texts)
    strict = {(r.entity, r.term) for r in pii.disclosing_terms(docs, found, threshold=0.25).collect()}
    assert strict == plain_terms(texts, 0.25) and ("email:one@time.org", "once") in strict
    assert {("email:a.b@c.org", "7741"), ("phone:13775550271", long), ("ip:10.1.2.3", "town"), ("email:tw@in.org", "twin")} <= got
    assert not any(e == "email:one@time.org" for e, _ in got)


def test_copies_prove_nothing_but_hide_nothing(spark):
    """An entity in many edited copies of one text: no term of theirs. The
    same entity in ten real texts too: the term beside it there is found."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    base = [word() for _ in range(300)]
    texts = [" ".join(word() for _ in range(60)) for _ in range(400)]
    for _ in range(40):
        edited = list(base)
        for _ in range(3):
            edited[rng.randrange(300)] = word()
        texts.append(" ".join([*edited[:150], "copied", "me@here.org", *edited[150:]]))
    plain = {(r.entity, r.term) for r in _terms(spark, texts)}
    assert plain == set()
    texts += [f"{' '.join(word() for _ in range(30))} realname me@here.org {' '.join(word() for _ in range(30))}" for _ in range(10)]
    assert {r.term for r in _terms(spark, texts)} == {"realname"}


def _terms(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return pii.disclosing_terms(docs, pii.find(docs)).collect()
