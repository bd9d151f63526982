import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import repair

GOOD = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """All edits of rows (turn, role, text), already in order: the cheapest,
    then ASCII-least, by a search over whole strings of edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.strip("\t\n\x0b\x0c\r ")
        kind = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(kind)
    # all ways as (roles written so far) -> {cost: set of (audit, output)}
    ways = {("", "", ())}
    best = [(0, "", "", ())]

    def insertions(found):
        out = list(found)
        for cost, audit, roles, texts in found:
            for r in ("user", "assistant", "user+assistant", "assistant+user"):
                c, a, o, t = cost, audit, roles, texts
                for name in r.split("+"):
                    c, a, o, t = c + 2, a + "I", o + name[0], (*t, f"{name}:")
                out.append((c, a, o, t))
        return out

    def prefix(roles):
        return re.fullmatch(r"s?(ua)*u?", roles)

    best = [w for w in insertions(best) if prefix(w[2])]
    for (_, role, text), fault in zip(rows, faults):
        step = []
        for cost, audit, roles, texts in best:
            step.append((cost + 3, audit + "D", roles, texts))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    step.append((cost + late, audit + "K", roles + role[0], (*texts, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    step.append((cost + 2 + late, audit + "R", roles + name[0], (*texts, f"{name}:{text}")))
        best = [w for w in insertions([w for w in step if prefix(w[2])]) if prefix(w[2])]
        # a plain bound: nobody needs more than five above the cheapest
        low = min(w[0] for w in best)
        best = [w for w in best if w[0] <= low + 5]
    cost, audit, _, texts = min(w for w in best if GOOD.fullmatch(w[2]))
    initials = [r[:1] for _, r, _ in rows]
    turns = {t for t, _, _ in rows if t is not None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost,
        audit,
        hashlib.sha256("\n".join(texts).encode()).hexdigest(),
    )


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    digest = lambda r, x: hashlib.md5(f"{r}\n{x}".encode()).hexdigest()
    return sorted(rows, key=lambda w: (w[0] is not None, w[0] or 0, w[1].encode(), digest(w[1], w[2])))


def conversation(rng, n):
    """Mostly in turn, with every kind of fault."""
    out = []
    for turn in range(n):
        role = ("user", "assistant")[turn % 2]
        if rng.random() < 0.25:
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "s", "ua"])
        text = rng.choice(["One.", "Two!", "three", "four? ", "five. six", "", " \n", None, f"text {rng.random()}."])
        out.append((None if rng.random() < 0.05 else turn + (rng.random() < 0.2) * 3, role, text))
        if rng.random() < 0.1:
            out.append(out[-1])
    return out


def run(spark, rows, **conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, edit string, part int")
        edits = repair.edits(df)
        return {r[0]: tuple(r)[1:] for r in repair.summary(edits).collect()}, edits.collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


MANY = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}


@pytest.mark.parametrize("conf", [{}, MANY])
def test_against_brute_force(spark, conf):
    """Short conversations, and long ones that cross several tasks."""
    rng = random.Random(11)
    by = {i: conversation(rng, rng.randrange(0, 9)) for i in range(60)}
    by |= {100 + i: conversation(rng, 30) for i in range(3)}
    by[None] = conversation(rng, 5)
    by[200] = [(k, "user", "same.") for k in range(7)] + [(3, "user", "same.")] * 20
    by[201] = [(None, "assistant", f"{k}.") for k in range(6)]
    by[202] = [(1, None, None)] * 9
    got, _ = run(spark, [(i, *r) for i, rows in by.items() for r in rows], **conf)
    want = {i: brute(ordered(rows)) for i, rows in by.items() if rows}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == want[i], (i, ordered(by[i]))


def test_hot_conversation_crosses_tasks(spark):
    rng = random.Random(4)
    rows = [(7, *r) for r in conversation(rng, 3000)] + [(i, 0, "user", "Hi.") for i in range(40)]
    got, edits = run(spark, rows, **MANY)
    one, _ = run(spark, rows)
    assert got == one and len({r.part for r in edits if r.conv_id == 7}) > 5
    written = "".join(r.role[0] for r in sorted(edits, key=lambda r: (r.part, r.seq)) if r.conv_id == 7 and r.role)
    assert GOOD.fullmatch(written)
    assert len({(r.part, r.seq) for r in edits if r.conv_id == 7}) == len(got[7][6])


def test_survivors_stay_few():
    """The undecided end stays short in a long conversation."""
    rng = random.Random(9)
    decided = []
    survivors = repair.Survivors(repair.NOTHING, lambda node: decided.append(node.edits))
    longest = 0
    for k in range(5000):
        initial = "ua"[k % 2] if rng.random() < 0.8 else rng.choice("suat")
        survivors.row(initial, rng.random() < 0.05, rng.random() < 0.1)
        longest = max(longest, *(len(survivors.undecided(s)) for s in survivors.best))
    assert longest < 60 and len(decided) > 4900


def test_detours_lose_nothing(monkeypatch):
    """Without dropping any state the edits are the same."""
    rng = random.Random(2)

    def edits(rows):
        done = []
        survivors = repair.Survivors(repair.NOTHING, lambda node: done.append(node.edits))
        for r in rows:
            survivors.row(*r)
        end = survivors.cheapest()
        return survivors.best[end][0], "".join(done + [n.edits for n in survivors.undecided(end)])

    cases = [
        [(rng.choice("ssuuuaaat"), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randrange(0, 12))]
        for _ in range(3000)
    ]
    got = [edits(c) for c in cases]
    monkeypatch.setattr(repair, "DETOUR", ((99,) * 4,) * 4)
    assert got == [edits(c) for c in cases]


def test_empty(spark):
    got, edits = run(spark, [])
    assert got == {} and edits == []


def test_query_against_brute_force(spark):
    from tessera.llm.queries import op11_conversation_repair

    d = "/root/testdata/sf0.001"
    by = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        rows = by.setdefault(r.conv_id, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        if kind:
            rows += [(r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    got = {r[0]: tuple(r)[1:] for r in op11_conversation_repair(spark, d).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {i: brute(ordered(rows)) if rows else empty for i, rows in by.items()}
    assert any(r[5] for r in got.values())
