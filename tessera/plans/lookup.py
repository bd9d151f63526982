"""J1: filter a table by the single value another query returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.subquery import scalar_subquery_filter
from tessera.sources.tables import read_table


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SELECT * FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)``.

    ``table`` is ``orders`` and ``table2`` the one-row result of the max: the
    aggregation is partial per file split, and the filter scans orders once."""
    orders = read_table(spark, sf_dir, "orders")
    latest = orders.select(F.max("o_orderdate").alias("o_orderdate"))
    return scalar_subquery_filter(orders, "o_orderdate", latest)
