import hashlib

import numpy as np

from tessera.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def brute(rows, k, rounds, dims, scale):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(t is not None and np.isfinite(t) for t in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(t)))) for t in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, of) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, near(x)[1], near(x)[0]) for i, x in kept], centres


def run(spark, rows, parts=3, **more):
    data = [(i, None if v is None else [None if t is None else float(t) for t in v], 1, "x") for i, v in rows]
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    return lloyd.cluster(df, **more)


def same(spark, rows, k=4, rounds=3, dims=10, scale=256, width=4):
    got = run(spark, rows, clusters=k, rounds=rounds, dims=dims, scale=scale, width=width)
    want, centres = brute(rows, k, rounds, dims, scale)
    key = lambda r: (r[0] is None, *r)
    assert sorted((tuple(r) for r in got.rows().collect()), key=lambda r: tuple(map(str, r))) == sorted(
        want, key=lambda r: tuple(map(str, r))
    )
    assert got.centroids.tolist() == centres
    return got, centres


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(rng.normal(size=(300, 10)).tolist()))
    got, centres = same(spark, rows, k=7, rounds=5)
    assert got.digest(0) == hashlib.sha256(",".join(map(str, centres[0])).encode()).hexdigest()


def test_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 10)).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(60)]  # a hot vector
    rows += [(3, base[4]), (3, base[3]), (None, base[5]), (None, base[6])]
    rows += [(50, None), (51, []), (52, base[0][:9]), (53, base[0] + [0.0]), (54, base[0][:9] + [None])]
    rows += [(55, base[0][:9] + [float("nan")]), (56, base[0][:9] + [float("inf")]), (57, [0.0] * 10), (58, [-0.0] * 10)]
    same(spark, rows)


def test_empty_clusters_keep_their_centroid(spark):
    rows = [(i, [1.0] * 10) for i in range(9)] + [(9, [2.0] * 10)]
    got, _ = same(spark, rows, k=6)
    assert {r.cluster for r in got.rows().collect()} <= set(range(6))


def test_fewer_vectors_than_clusters_and_none(spark):
    same(spark, [(1, [0.5] * 10), (2, [0.25] * 10)], k=6)
    assert run(spark, [(1, [0.5] * 9), (2, None)], dims=10) is None


def test_huge_components_do_not_overflow(spark):
    got = run(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], clusters=1, rounds=2)
    assert all(0 <= r.distance < 2**63 for r in got.rows().collect()) and got.rows().count() == 3


def test_query_matches_its_sql(spark):
    import duckdb

    from tessera.llm.queries import ORACLE_SQL, op12_centroid_clusters

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = con.execute(ORACLE_SQL["op12_centroid_clusters"]).fetchall()
    got = [tuple(r) for r in op12_centroid_clusters(spark, d).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
