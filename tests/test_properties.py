"""Invariants that hold on any data (checked on the smallest test tables)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.plans import commerce, orders
from tessera.plans.registry import Run

from .conftest import SMALL


def q(spark, key):
    return entry.queries()[key](spark, SMALL)


def test_ntile_buckets_differ_by_at_most_one(spark):
    cop = q(spark, "customer_order_patterns")
    for col in ("monetary_segment", "frequency_segment"):
        sizes = Counter(r[0] for r in cop.select(col).collect())
        assert set(sizes) <= set(range(1, 6))
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_daily_revenue_adds_up_to_product_revenue(spark):
    # on the jobs' exact DECIMAL outputs (registered results report DOUBLE)
    run = Run.get(spark, SMALL)
    daily = commerce.time_analysis(run.tx).agg(F.sum("daily_revenue")).first()[0]
    products = run.pm.agg(F.sum("total_revenue")).first()[0]
    assert daily == products


def test_cumulative_revenue_ends_at_category_total(spark):
    run = Run.get(spark, SMALL)
    tbs = orders.time_based_sales(run.order_items_detail)
    last = {r["category_id"]: r["cumulative_revenue"] for r in
            tbs.orderBy("month").collect()}
    totals = {r["category_id"]: r["t"] for r in tbs.groupBy("category_id").agg(F.sum("monthly_revenue").alias("t"))
              .collect()}
    assert last == totals


def test_retention_is_a_percentage(spark):
    mc = q(spark, "monthly_cohorts")
    lo, hi = mc.agg(F.min("retention_rate"), F.max("retention_rate")).first()
    assert 0 <= lo <= hi <= 100


def test_sequence_has_one_row_per_sale_and_history_one_per_line(spark):
    tx = q(spark, "clean_transactions")
    assert q(spark, "purchase_history").count() == tx.count()
    assert q(spark, "purchase_sequence").count() == tx.filter(~F.col("is_return")).count()


def test_customer_360_is_top_n_by_spend(spark):
    c360 = q(spark, "customer_360")
    spends = [r[0] for r in c360.select("total_spend").collect()]
    assert spends == sorted(spends, reverse=True)
