"""Top-count sketches: exact while few values are tracked, mergeable, and
within their error bound beyond that."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.plans import commerce


@pytest.fixture(scope="module")
def tx(spark):
    rnd = random.Random(3)
    data = [
        (rnd.randrange(4), rnd.randrange(6), int(rnd.paretovariate(0.7)) % 900, rnd.choice([None, "x", "y"]), rnd.choice("mt"))
        for _ in range(4000)
    ]
    return spark.createDataFrame(
        data, "user_id long, month int, payment_method long, shipping_country string, device_type_clean string"
    ).repartition(5)


def counts(tx, column):
    return {(r.user_id, r[column]): r["count"] for r in tx.groupBy("user_id", column).count().collect()}


@pytest.mark.parametrize("merged", [False, True])
def test_estimates_are_exact_up_to_the_tracked_values(tx, merged):
    sketches = commerce.mode_sketches(tx, ["user_id", "month"] if merged else ["user_id"])
    if merged:
        sketches = commerce.merged_sketches(sketches)
    got = commerce.modes_of(sketches).collect()
    assert len(got) == 4
    for name, column in commerce.MODES.items():
        exact = counts(tx, column)
        for r in got:
            assert r[f"{name}_count"] == exact[r.user_id, r[name]] == max(c for (u, _), c in exact.items() if u == r.user_id)


@pytest.mark.parametrize("tracked", [20, 60])
def test_error_bound_with_few_tracked_values(tx, tracked):
    sketches = commerce.mode_sketches(tx, ["user_id", "month"], tracked)
    got = commerce.modes_of(commerce.merged_sketches(sketches, tracked=tracked)).withColumn(
        "bound", commerce.mode_error(F.col("n"), tracked)
    )
    exact = counts(tx, "payment_method")
    for r in got.collect():
        top = max(c for (u, _), c in exact.items() if u == r.user_id)
        chosen = exact[r.user_id, r.most_used_payment_method]
        assert abs(r.most_used_payment_method_count - chosen) <= r.bound
        assert chosen >= top - 2 * r.bound and r.bound > 0


def test_one_aggregation(tx):
    plan = commerce.customer_modes_approx(tx)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
