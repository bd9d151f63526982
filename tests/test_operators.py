"""The skew-safe helpers equal Spark's own windows and brute force.

Inputs include a hot key holding a third of the rows, the case the helpers
exist for.
"""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.lookback import lookback_distinct_count
from tessera.operators.pages import paged_arrays, unnest
from tessera.operators.ranking import global_row_number, ntile_by_value, ranked
from tessera.operators.selection import percentile_cont, values_at
from tessera.operators.sequence import lead_within, position_within, running_sums
from tessera.operators.slices import lead_by_slices, position_by_slices
from tessera.operators.subquery import scalar_subquery_filter
from tessera.operators.topvalue import top_values

from .conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    data = []
    for i in range(900):
        key = 0 if i % 3 == 0 else rnd.randint(1, 40)  # key 0 holds a third
        data.append((i, key, rnd.randint(0, 60), rnd.choice(["a", "b", "c", None])))
    return spark.createDataFrame(data, "id long, k long, v long, s string")


def test_global_row_number_is_a_permutation(skewed):
    out = global_row_number(skewed, [F.col("v").asc(), F.col("id").asc()], name="rn", total="n")
    got = rows(out, "id", "rn", "n")
    expected = rows(
        skewed.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rn"), F.lit(900).alias("n"))
    )
    assert got == [(a, b, c) for a, b, c in expected]


@pytest.mark.parametrize("tiles", [1, 3, 5, 7])
def test_global_ntile_equals_builtin(skewed, tiles):
    nulls = skewed.withColumn("v", F.when(F.col("id") % 11 != 0, F.col("v")))
    for df in (skewed, nulls, nulls.withColumn("v", F.lit(3)), nulls.withColumn("v", F.col("v") % 3)):
        out = ntile_by_value(df, "v", "id", tiles, "t")
        expected = df.select("id", F.ntile(tiles).over(Window.orderBy("v", "id")).alias("t"))
        assert rows(out, "id", "t") == rows(expected) and out.columns == [*df.columns, "t"]


def test_ntile_on_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, v long")
    out = ntile_by_value(df, "v", "id", 5, "t")
    assert rows(out, "id", "t") == [(1, 1), (2, 2), (3, 3)]


def test_ranked_equals_builtin_rank_and_percent_rank(skewed):
    out = ranked(
        skewed, [F.col("v").desc()], ["v"], tiebreak=["id"], partition_by=["k"], rank="r", row_number="rn"
    )
    out = ranked(out, [F.col("v").desc()], ["v"], tiebreak=["id"], percent_rank="pr")
    w = Window.partitionBy("k").orderBy(F.col("v").desc())
    expected = skewed.select(
        "id",
        F.rank().over(w).alias("r"),
        F.row_number().over(w.orderBy(F.col("v").desc(), "id")).alias("rn"),
        F.percent_rank().over(Window.orderBy(F.col("v").desc())).alias("pr"),
    )
    assert rows(out, "id", "r", "rn", "pr") == rows(expected)


def test_ranks_write_the_histogram_only(skewed, monkeypatch):
    """What is put in order and written is (value, count), not the rows."""
    from tessera.operators import ranking

    written, real = [], ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, name: written.append(df) or real(df, name))
    ranked(skewed, [F.col("v").desc()], ["v"], partition_by=["k"], rank="r", percent_rank="p").count()
    (histogram,) = written
    assert set(histogram.columns) == {"k", "v", "__count", "__pid"}
    assert histogram.count() == skewed.select("k", "v").distinct().count()


def test_percent_rank_single_row(spark):
    df = spark.createDataFrame([(1, 5)], "id long, v long")
    out = ranked(df, [F.col("v").desc()], ["v"], tiebreak=["id"], percent_rank="pr")
    assert rows(out, "pr") == [(0.0,)]


def test_group_percentile_equals_builtin(skewed):
    got = percentile_cont(skewed, ["k"], "v", 0.5, "m")
    expected = skewed.groupBy("k").agg(F.percentile("v", 0.5).alias("m"))
    g = {k: m for k, m in rows(got)}
    e = {k: m for k, m in rows(expected)}
    assert g.keys() == e.keys()
    assert all(abs(g[k] - e[k]) < 1e-9 for k in g)
    overall = percentile_cont(skewed, [], "v", 0.25, "m").first()["m"]
    assert abs(overall - skewed.agg(F.percentile("v", 0.25)).first()[0]) < 1e-9


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_lead_and_position_equal_builtin(skewed, width):
    """Whatever the buckets: one per value, several values each, or one."""
    nulls = skewed.withColumn("v", F.when(F.col("id") % 11 != 0, F.col("v"))).withColumn(
        "k", F.when(F.col("id") % 13 != 0, F.col("k"))
    )
    bucket = F.floor(F.col("v") / width)
    out = lead_within(nulls, ["k"], ["v", "id"], bucket, {"next_v": "v", "next_s": "s"}, position="pos")
    w = Window.partitionBy("k").orderBy("v", "id")
    expected = nulls.select(
        "id", F.lead("v").over(w).alias("next_v"), F.lead("s").over(w).alias("next_s"),
        F.row_number().over(w).alias("pos"),
    )
    assert rows(out, "id", "next_v", "next_s", "pos") == rows(expected)
    pos = position_within(nulls, ["k"], ["v", "id"], bucket, "pos")
    assert rows(pos, "id", "pos") == rows(expected.select("id", "pos"))


@pytest.mark.parametrize("slice_rows", [1, 40, 10**6])
def test_lead_by_slices_equals_builtin(skewed, slice_rows):
    """Every key cut, the hot one alone, none; NULL keys and values too."""
    nulls = skewed.withColumn("v", F.when(F.col("id") % 11 != 0, F.col("v"))).withColumn(
        "k", F.when(F.col("id") % 13 != 0, F.col("k"))
    )
    bucket = F.floor(F.col("v") / 7)
    out = lead_by_slices(nulls, ["k"], ["v", "id"], bucket, {"next_v": "v", "next_s": "s"}, "pos", slice_rows)
    w = Window.partitionBy("k").orderBy("v", "id")
    expected = nulls.select(
        "id", F.lead("v").over(w).alias("next_v"), F.lead("s").over(w).alias("next_s"), F.row_number().over(w).alias("pos")
    )
    assert rows(out, "id", "next_v", "next_s", "pos") == rows(expected)
    assert out.columns == [*nulls.columns, "next_v", "next_s", "pos"]
    pos = position_by_slices(nulls, ["k"], ["v", "id"], bucket, "pos", slice_rows)
    assert rows(pos, "id", "pos") == rows(expected.select("id", "pos"))


def test_slices_shuffle_rows_once_and_spread_a_hot_key(skewed):
    """Ordinary keys: one exchange of the rows. A hot key: its rows in several
    partitions."""
    plain = lead_by_slices(skewed, ["k"], ["v", "id"], F.col("v"), {"n": "v"}, "pos")
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    cut = lead_by_slices(skewed, ["k"], ["v", "id"], F.col("v"), {"n": "v"}, "pos", slice_rows=50)
    parts = cut.filter("k = 0").withColumn("p", F.spark_partition_id()).select("p").distinct().count()
    assert parts > 1


@pytest.mark.parametrize("page_size,slice_rows", [(1, 10**6), (7, 40), (64, 10**6), (10**6, 10**6)])
def test_pages_in_order_are_the_long_form(skewed, page_size, slice_rows):
    pages = paged_arrays(skewed, ["k"], ["v", "id"], F.col("v"), ["id", "s"], page_size, slice_rows)
    got = {}
    for r in pages.orderBy("k", "page").collect():
        mine = got.setdefault(r.k, [])
        assert 1 <= len(r["items"]) <= page_size and r.first_position == len(mine) + 1
        assert r.page == len(mine) // page_size
        mine += [(i.position, i.id, i.s) for i in r["items"]]
    w = Window.partitionBy("k").orderBy("v", "id")
    want = {}
    for r in skewed.select("k", F.row_number().over(w).alias("p"), "id", "s").orderBy("k", "p").collect():
        want.setdefault(r.k, []).append((r.p, r.id, r.s))
    assert got == want


@pytest.mark.parametrize("page_size", [1, 7, 10**6])
def test_unnest_leads_across_page_ends(skewed, page_size):
    pages = paged_arrays(skewed, ["k"], ["v", "id"], F.col("v"), ["id", "v", "s"], page_size, 40)
    got = unnest(pages, ["k"], {"at": "position", "id": "id", "v": "v"}, {"next_id": "id", "next_s": "s"})
    w = Window.partitionBy("k").orderBy("v", "id")
    want = skewed.select(
        "k", F.row_number().over(w).alias("at"), "id", "v", F.lead("id").over(w).alias("next_id"),
        F.lead("s").over(w).alias("next_s"),
    )
    assert rows(got) == rows(want)


def test_pages_of_nothing_and_bad_size(spark):
    empty = spark.createDataFrame([], "k long, v long")
    assert paged_arrays(empty, ["k"], ["v"], F.col("v"), ["v"]).collect() == []
    with pytest.raises(ValueError):
        paged_arrays(empty, ["k"], ["v"], F.col("v"), ["v"], page_size=0)


@pytest.mark.parametrize("accuracy", [2, 10, 10_000])
def test_selection_is_exact_whatever_the_sketch(spark, accuracy):
    """A coarse sketch, ties, NULLs, NULL groups, groups of one row."""
    rnd = random.Random(accuracy)
    data = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, float(rnd.randint(0, 9)), rnd.gauss(0, 1e6)])) for _ in range(3000)]
    data += [(4, 5.0), (5, None), (6, -0.0), (6, 0.0)]
    df = spark.createDataFrame(data, "g long, v double").repartition(6)
    by = {}
    for g, v in data:
        if v is not None:
            by.setdefault(g, []).append(v)
    ranks = lambda n: [F.lit(0), F.floor(n / 3), F.floor(n / 2), n - 1]
    got = {r.g: (r.n, list(r["at"])) for r in values_at(df, ["g"], "v", [0.0, 1 / 3, 0.5, 1.0], ranks, accuracy).collect()}
    want = {}
    for g, vs in by.items():
        vs, n = sorted(vs), len(vs)
        want[g] = (n, [vs[0], vs[n // 3], vs[n // 2], vs[-1]])
    assert got == want
    med = {r.g: r.m for r in percentile_cont(df, ["g"], "v", 0.5, "m", accuracy).collect()}
    exact = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect() if r.m is not None}
    assert med.keys() == exact.keys() and all(med[g] == pytest.approx(exact[g], abs=1e-9) for g in exact)


def test_selection_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert percentile_cont(empty, [], "v", 0.5, "m").first()["m"] is None
    assert percentile_cont(empty.selectExpr("1 AS g", "v"), ["g"], "v", 0.5, "m").collect() == []


def test_running_sums_equal_builtin(skewed):
    df = skewed.withColumn("w", F.when(F.col("s") == "a", F.lit(-1)).otherwise(F.lit(2))).withColumn(
        "b", F.floor(F.col("v") / 9)
    )
    got = running_sums(df, ["k"], ["v", "id"], "b", {"before_w": F.col("w"), "before_n": F.lit(1)})
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    expected = df.select(
        "id",
        F.coalesce(F.sum("w").over(w), F.lit(0)).alias("before_w"),
        F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)).alias("before_n"),
    )
    assert rows(got, "id", "before_w", "before_n") == rows(expected)


def test_top_values_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None), (2, None), (2, "z"), (3, None)],
        "k long, s string",
    )
    got = dict(rows(top_values(df, ["k"], {"m": "s"})))
    assert got == {1: "a", 2: None, 3: None}  # tie -> lowest; NULL counted
    got2 = dict(rows(top_values(df, ["k"], {"m": "s"}, count_nulls=False)))
    assert got2 == {1: "a", 2: "z"}


def test_lookback_equals_brute_force(spark):
    rnd = random.Random(3)
    base = dt.datetime(2020, 1, 1)
    events = []
    for i in range(400):
        key = 0 if i % 3 == 0 else rnd.randint(1, 6)
        t = base + dt.timedelta(hours=rnd.randint(0, 24 * 120))
        sid = i if i % 10 else i - 1  # some session ids repeat with another time
        events.append((sid, key, t))
    probes = [(j, rnd.randint(0, 7), base + dt.timedelta(hours=rnd.randint(0, 24 * 120))) for j in range(150)]
    # exact bounds: an event at t - 30 days and one at t are both counted
    k0, t0 = probes[0][1], probes[0][2]
    events.append((10_001, k0, t0 - dt.timedelta(days=30)))
    events.append((10_002, k0, t0))
    ev = spark.createDataFrame(events, "sid long, k long, t timestamp_ntz")
    pr = spark.createDataFrame(probes, "pid long, k long, t timestamp_ntz")
    got = dict(rows(lookback_distinct_count(pr, "pid", "k", "t", ev, "sid", "k", "t", 30, "n"), "pid", "n"))
    for pid, k, t in probes:
        lo = t - dt.timedelta(days=30)
        expect = len({s for s, ek, et in events if ek == k and lo <= et <= t})
        assert got[pid] == expect, (pid, got[pid], expect)


def test_scalar_subquery_filter(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    one = spark.createDataFrame([(2,)], "a long")
    assert rows(scalar_subquery_filter(df, "a", one)) == [(2, "y")]
    empty = spark.createDataFrame([], "a long")
    assert scalar_subquery_filter(df, "a", empty).count() == 0
    two = spark.createDataFrame([(1,), (2,)], "a long")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS|more than one row"):
        scalar_subquery_filter(df, "a", two).collect()


def test_a_hot_key_is_cut_into_buckets(spark):
    """A key with 90 % of the rows: no window group of the plan, by (key,
    bucket), holds more than its bucket, and LEAD, position and look-back
    are right across the buckets."""
    n = 20_000
    start = dt.datetime(2020, 1, 1)
    df = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(0)).alias("k"),
        (F.lit(start) + F.make_dt_interval(hours=(F.col("id") * 7 % 1000).cast("int"))).cast("timestamp_ntz").alias("t"),
        "id",
    )
    day = F.unix_date(F.to_date("t"))
    assert df.groupBy("k", day).count().agg(F.max("count")).first()[0] < 0.05 * n
    out = lead_within(df, ["k"], ["t", "id"], day, {"nt": "t"}, position="pos").filter(F.col("k") == 0).collect()
    hot = sorted((r.t, r.id, r.nt, r.pos) for r in out)
    assert [r[3] for r in hot] == list(range(1, int(0.9 * n) + 2))  # id 0 also has k = 0
    assert [r[2] for r in hot] == [r[0] for r in hot[1:]] + [None]
    probes = df.filter(F.col("id") % 97 == 1).select("id", "k", "t")
    got = dict(rows(lookback_distinct_count(probes, "id", "k", "t", df, "id", "k", "t", 3, "n"), "id", "n"))
    times = [r[0] for r in hot]
    for p in probes.filter("k = 0").collect():
        lo = p.t - dt.timedelta(days=3)
        assert got[p.id] == sum(lo <= t <= p.t for t in times)


def test_top_by_spend_is_the_exact_top(spark):
    from tessera.plans.commerce import top_by_spend

    df = spark.range(3000).select(  # heavy ties, some users without a known spend
        F.when(F.col("id") % 41 != 0, F.col("id") % 37).alias("total_spend"),
        (F.col("id") % 5).alias("total_transactions"),
        F.col("id").alias("user_id"),
    )
    order = [F.desc("total_spend"), F.desc("total_transactions"), "user_id"]
    for k in (1, 10, 700, 2999, 5000):
        assert rows(top_by_spend(df, k)) == rows(df.orderBy(*order).limit(k))


def test_release_deletes_staged_tables(spark):
    import os

    from tessera.operators.staging import _PATHS, stage
    from tessera.plans.registry import Run

    staged = stage(spark.range(10), ("release-test",))
    global_row_number(spark.range(10), ["id"]).count()
    paths = [p.replace("file:", "") for p in _PATHS.values()]
    assert staged.count() == 10 and all(map(os.path.exists, paths)) and any("ranged" in p for p in paths)
    Run.release(spark)  # forgets cached runs too, so none points at deleted files
    assert not any(map(os.path.exists, paths))


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from tessera.session import checkpoint_dir

    def session(master, conf=None, context=None):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: context)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: conf))

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_dir(session(master))
        assert checkpoint_dir(session(master, conf="hdfs://x/y/")) == "hdfs://x/y"
        assert checkpoint_dir(session(master, context="hdfs://c")) == "hdfs://c"


def test_changed_inputs_and_limits_are_seen(spark, tmp_path):
    from tessera.plans.params import Params
    from tessera.plans.registry import Run

    assert Params(top_limit=5).key() != Params().key()
    folder = str(tmp_path)
    spark.range(3).write.parquet(f"{folder}/region.parquet")
    first = Run.get(spark, folder)
    assert Run.get(spark, folder) is first
    assert Run.get(spark, folder, Params(top_limit=5)) is not first
    os_path = tmp_path / "region.parquet"
    spark.range(5).write.mode("append").parquet(str(os_path))
    assert Run.get(spark, folder) is not first


def test_values_keep_their_type(spark):
    df = spark.createDataFrame([(1, 0.0, 10), (1, -0.0, 9), (1, 2.5, 9)], "k long, x double, n int")
    from tessera.operators.distinct import distinct_counts

    assert rows(distinct_counts(df, ["k"], {"dx": "x", "dn": "n"})) == [(1, 2, 2)]
    top = top_values(df, ["k"], {"mx": "x", "mn": "n"}, distinct={"dx": "x"})
    assert dict(top.dtypes) == {"k": "bigint", "mx": "double", "mn": "int", "dx": "bigint"}
    assert rows(top) == [(1, 0.0, 9, 2)]


def test_distinct_counts_equal_builtin(skewed):
    from tessera.operators.distinct import with_distinct_counts

    df = skewed.withColumn("g", F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("k") % 5))
    values = {"ds": "s", "dv": "v", "dvs": F.when(F.col("s") == "a", F.col("v"))}
    base = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = with_distinct_counts(base, df, ["g"], values)
    expected = df.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("s").alias("ds"),
        F.countDistinct("v").alias("dv"),
        F.countDistinct(F.when(F.col("s") == "a", F.col("v"))).alias("dvs"),
    )
    assert rows(got, "g", "n", "ds", "dv", "dvs") == rows(expected, "g", "n", "ds", "dv", "dvs")


def test_conditional_distinct_counts_equal_builtin(skewed):
    from tessera.operators.distinct import distinct_counts_of

    got = distinct_counts_of(skewed, ["k"], "v", {"all": None, "a": F.col("s") == "a", "nb": F.col("s") != "b"})
    expected = skewed.groupBy("k").agg(
        F.countDistinct("v").alias("all"),
        F.countDistinct(F.when(F.col("s") == "a", F.col("v"))).alias("a"),
        F.countDistinct(F.when(F.col("s") != "b", F.col("v"))).alias("nb"),
    )
    assert rows(got, "k", "all", "a", "nb") == rows(expected, "k", "all", "a", "nb")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_staged_by_a_key_are_not_shuffled_again(spark):
    from tessera.operators.staging import stage_by

    df = spark.createDataFrame([(i % 7 if i % 7 else None, i) for i in range(100)], "u long, v long")
    per_key = lambda t: t.groupBy("u", "v").agg(F.count("*").alias("n")).groupBy("u").agg(F.sum("n"), F.max("v"))
    staged = stage_by(df, ("by-test",), "u", 3)
    assert staged is stage_by(df, ("by-test",), "u", 3) and staged.schema == df.schema
    assert rows(staged) == rows(df) and rows(per_key(staged)) == rows(per_key(df))
    assert "Exchange" not in _plan(per_key(staged)) and "Exchange" in _plan(per_key(df))
    # a value with more rows than one task should read: plain files, combined map-side
    hot = stage_by(df, ("by-test-hot",), "u", 3, hot_rows=14)
    assert rows(hot) == rows(df) and rows(per_key(hot)) == rows(per_key(df))
    assert "Exchange" in _plan(per_key(hot))
    assert stage_by(df.limit(0), ("by-test-empty",), "u", 3).count() == 0


def test_jobs_per_user_do_not_shuffle_the_transactions(spark):
    from tessera.plans import commerce
    from tessera.plans.registry import Run

    tx = Run.get(spark, "/root/testdata/sf0.001").tx
    for df in (commerce.purchase_sequence(tx), commerce.latest_category(tx), commerce.primary_products(tx)):
        assert "Exchange" not in _plan(df)


def test_release_drops_the_tables_of_buckets(spark):
    from tessera.operators.staging import _TABLES, stage_by
    from tessera.plans.registry import Run

    stage_by(spark.range(10), ("drop-test",), "id", 2)
    tables = list(_TABLES.values())
    assert tables and all(map(spark.catalog.tableExists, tables))
    Run.release(spark)
    assert not any(map(spark.catalog.tableExists, tables)) and not _TABLES
