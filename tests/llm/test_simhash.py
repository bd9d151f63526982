import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash


def plain(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    """Smallest id of each component by comparing all pairs."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def components_of(spark, fps, slab=simhash.SLAB):
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps)]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), slab=slab)
    pairs = {i: f for i, f in enumerate(sorted(set(fps)))}
    at = {f: i for i, f in pairs.items()}
    root = {i: i for i in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found.collect():
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4 and a != b
        x, y = sorted((find(at[a]), find(at[b])))
        root[y] = x
    return {i: find(i) for i in pairs}, brute(pairs)


def test_fingerprints_of_texts():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "one two", "A b C d", "é É ß x y z w"]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "long" * 9, "x\u0085y"]) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(map(str, range(5000)))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole


def test_masks_cover_every_close_pair():
    rng = random.Random(1)
    masks = [m % (1 << 64) for m in simhash.masks()]
    assert len(masks) == 70 and all(m.bit_count() == 32 for m in masks)
    for _ in range(2000):
        apart = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(apart & m == 0 for m in masks)


@pytest.mark.parametrize("slab", [3, simhash.SLAB])
def test_links_against_brute_force(spark, slab):
    """Chains, a crowd around one value, and members that the smallest of a
    bucket does not reach."""
    rng = random.Random(7)
    fps = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(12):  # a chain: neighbours 1 to 5 bits apart
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                at ^= 1 << b
            fps.append(at)
    crowd = rng.getrandbits(64)
    for _ in range(150):
        fps.append(crowd ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))))
    low = rng.getrandbits(32) << 32  # many in one bucket, in several components
    fps += [low | rng.getrandbits(12) * 0x11111 % (1 << 32) for _ in range(120)]
    got, want = components_of(spark, fps, slab)
    assert got == want
    assert 1 < len(set(want.values())) < len(want)


def test_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150", "other")
    rows = [(5, base), (3, base.upper()), (9, near), (None, base), (7, None), (8, ""), (2, " \n "), (4, "alone here")]
    rows += [(5, base)] * 3 + [(None, "no id " * 9)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.classes(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.class_size))
    assert by[7] == by[8] == by[2] == {(2, 3)}
    assert by[5] == by[3]
    assert {c for c, _ in by[4]} == {4}
    fps = {i: plain(t) for i, t in rows if i is not None}
    want = brute(fps)
    assert {i: {c for c, _ in s} for i, s in by.items() if i is not None} == {i: {c} for i, c in want.items()}
    assert (None, 1) in by[None]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(docs).collect() == []


def test_query_against_brute_force(spark):
    from tessera.llm.queries import op13_simhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain(r.text) for r in docs}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op13_simhash(spark, "/root/testdata/sf0.001").collect()}
    want = brute(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)
