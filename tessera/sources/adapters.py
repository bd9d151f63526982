"""Reference-shaped input tables derived from the test tables.

The reference queries read e-commerce and epidemiology tables that the test
data does not have. Each adapter below derives one of them from the TPC-H-like
tables with a single SQL statement. The statements are written in the subset
of SQL that Spark and DuckDB read the same way, so the Spark jobs and the
DuckDB oracle start from identical inputs. ``{name}`` marks a base table: in
Spark it is bound to a DataFrame through ``spark.sql(text, name=df)``, in
DuckDB to the view of that name.

The few adapters whose row-generating step differs between the engines
(``inventory``) keep one text per engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read_table

# Expressions that make each reference column from the test
# tables (category ids, the device rotation, the date shifts).
CATEGORY_ID = (
    "case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 "
    "when 'PROMO' then 4 when 'SMALL' then 5 else 6 end"
)
SESSION_SHIFT = "interval '1' day * (8200 + event_id % 2240)"


@dataclass(frozen=True)
class Adapter:
    name: str
    sql: str
    tables: tuple[str, ...]


ADAPTERS: dict[str, Adapter] = {}


def _register(name: str, tables: tuple[str, ...], sql: str) -> None:
    ADAPTERS[name] = Adapter(name, sql.strip(), tables)


_register(
    "transactions",
    ("lineitem", "orders", "part", "customer", "nation"),
    """
SELECT
  o_orderkey AS transaction_id,
  o_custkey AS user_id,
  cast(o_orderdate + interval '1' minute * (o_orderkey % 1440) as string) AS transaction_time,
  l_partkey AS product_id,
  p_type AS product_category,
  cast(l_quantity as bigint) AS quantity,
  case when l_partkey % 41 = 0 then null else cast(p_retailprice / 1000 as decimal(18,4)) end AS unit_price,
  o_orderpriority AS payment_method,
  n_name AS shipping_country,
  case o_orderkey % 4 when 0 then 'mobile' when 1 then 'tablet' when 2 then 'desktop' else 'tv' end AS device_type,
  l_returnflag = 'R' AS is_return,
  o_orderkey % 50 = 0 AS is_test_transaction
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {part} ON l_partkey = p_partkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey
""",
)

_register(
    "customers",
    ("customer", "nation"),
    """
SELECT
  c_custkey AS customer_id,
  c_name AS first_name,
  c_mktsegment AS last_name,
  concat(c_name, '@example.com') AS email,
  date '2001-08-01' - cast((c_custkey * 37) % 2400 as int) AS registration_date,
  n_name AS country,
  concat('City_', cast(c_custkey % 3 as string)) AS city,
  cast(10000 + c_custkey % 500 as string) AS postal_code
FROM {customer}
JOIN {nation} ON c_nationkey = n_nationkey
""",
)

_register(
    "customer_subscriptions",
    ("customer",),
    """
SELECT
  c_custkey AS customer_id,
  c_mktsegment AS subscription_tier,
  date '1998-01-01' + cast(c_custkey % 1500 as int) AS subscription_start_date,
  case when c_custkey % 6 = 0 then null
       else date '1998-01-01' + cast(c_custkey % 1500 + 365 as int) end AS subscription_end_date,
  cast(5 + c_custkey % 20 as decimal(18,2)) AS monthly_fee
FROM {customer}
""",
)

_register(
    "user_sessions",
    ("events",),
    f"""
SELECT
  event_id AS session_id,
  user_id AS customer_id,
  ts - {SESSION_SHIFT} AS session_timestamp
FROM {{events}}
""",
)

_register(
    "orders",
    ("orders",),
    """
SELECT
  o_orderkey AS order_id,
  o_custkey AS customer_id,
  cast(o_orderdate as date) AS order_date,
  o_orderdate + interval '1' minute * (o_orderkey % 1440) AS order_timestamp,
  o_orderdate + interval '1' minute * (o_orderkey % 1440 - o_orderkey % 97)
    - interval '1' second * (o_orderkey % 60) AS cart_creation_timestamp,
  cast(o_totalprice as decimal(18,2)) AS total_amount,
  cast(o_orderkey % 20 as decimal(18,2)) AS discount_amount,
  cast(5 + o_orderkey % 7 as decimal(18,2)) AS shipping_cost,
  cast(o_orderkey % 11 as decimal(18,2)) AS tax_amount,
  case when o_orderkey % 9 = 0 then null else o_orderpriority end AS payment_method,
  case o_orderstatus when 'F' then 'Delivered' when 'O' then 'Returned' else 'Cancelled' end AS order_status,
  o_custkey * 10 AS delivery_address_id,
  case when o_orderkey % 2 = 0 then 'ground' else 'air' end AS shipping_method,
  cast(o_orderdate as date) + 7 AS estimated_delivery_date,
  case when o_orderkey % 11 = 0 then null
       else cast(o_orderdate as date) + cast(o_orderkey % 15 as int) end AS actual_delivery_date
FROM {orders}
""",
)

_register(
    "order_items",
    ("lineitem", "part"),
    """
SELECT
  l_orderkey AS order_id,
  l_partkey AS product_id,
  cast(l_quantity as bigint) AS quantity,
  case when l_partkey % 41 = 0 then null else cast(p_retailprice as decimal(18,2)) end AS unit_price,
  cast(round(l_discount * 100) as int) AS discount_percentage
FROM {lineitem}
JOIN {part} ON l_partkey = p_partkey
""",
)

_register(
    "products",
    ("part", "supplier"),
    f"""
SELECT
  p_partkey AS product_id,
  p_name AS product_name,
  {CATEGORY_ID} AS category_id,
  p_size AS subcategory_id,
  cast(substring(p_brand, 7) as int) AS brand_id,
  1 + p_partkey % (SELECT count(*) FROM {{supplier}}) AS supplier_id,
  cast(p_retailprice * 0.6 as decimal(18,2)) AS unit_cost,
  cast(p_size * 0.1 as decimal(10,1)) AS weight_kg,
  p_size % 2 = 0 AS is_perishable,
  p_size * 10 AS shelf_life_days
FROM {{part}}
""",
)

_register(
    "product_categories",
    ("part",),
    f"SELECT DISTINCT {CATEGORY_ID} AS category_id, p_type AS category_name FROM {{part}}",
)

_register(
    "product_subcategories",
    ("part",),
    "SELECT DISTINCT p_size AS subcategory_id, 'Sub_' || cast(p_size as string) AS subcategory_name FROM {part}",
)

_register(
    "brands",
    ("part",),
    "SELECT DISTINCT cast(substring(p_brand, 7) as int) AS brand_id, p_brand AS brand_name FROM {part}",
)

_register(
    "suppliers",
    ("supplier", "nation"),
    """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name, n_name AS country
FROM {supplier}
JOIN {nation} ON s_nationkey = n_nationkey
""",
)

_register(
    "warehouses",
    ("region",),
    """
SELECT r_regionkey AS warehouse_id, r_regionkey <> 3 AS is_active
FROM {region}
""",
)

_register(
    "product_reviews",
    ("lineitem", "orders"),
    """
SELECT
  l_partkey AS product_id,
  o_custkey AS customer_id,
  1 + (l_orderkey + l_partkey) % 5 AS review_rating,
  cast(o_orderdate as date) + l_linenumber AS review_date
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
""",
)

_register(
    "customer_support_tickets",
    ("events",),
    f"""
SELECT
  user_id AS customer_id,
  cast(ts - {SESSION_SHIFT} as date) AS created_date,
  1 + event_id % 5 AS satisfaction_score
FROM {{events}}
""",
)

# The epidemiology table: one row per (month, country[, segment[, priority]]),
# at three aggregation levels. Sub-region-1 codes are known for nations with
# key % 3 >= 1, sub-region-2 codes for key % 3 = 2, so the finest level that
# has codes differs between countries.
# One join and one aggregation over grouping sets make all three levels.
_register(
    "covid19_open_data",
    ("orders", "customer", "nation"),
    """
SELECT
  date,
  'C' || cast(nation_key as string) AS country_code,
  country_name,
  case when nation_key % 3 >= 1 then sub1 end AS subregion1_code,
  'Segment ' || sub1 AS subregion1_name,
  case when nation_key % 3 = 2 then sub2 end AS subregion2_code,
  'Priority ' || sub2 AS subregion2_name,
  concat_ws('_', 'C' || cast(nation_key as string), sub1, sub2) AS location_key,
  aggregation_level,
  cast(nation_key * 3 as double) / 2 AS latitude,
  cast(region_key * 20 - 40 as double) AS longitude,
  'POINT(' || cast(region_key * 20 - 40 as string) || ' ' || cast(nation_key * 3 as string) || ')' AS location_geometry,
  n * 100 AS cumulative_confirmed,
  n * 2 AS cumulative_deceased,
  case when month(date) = 1 then null else n * 60 end AS cumulative_recovered
FROM (
  SELECT date, nation_key, region_key, country_name, sub1, sub2, n,
         case when g1 = 1 then 0 when g2 = 1 then 1 else 2 end AS aggregation_level
  FROM (
    SELECT d AS date, nk AS nation_key, rk AS region_key, nm AS country_name, seg AS sub1, pri AS sub2,
           grouping(seg) AS g1, grouping(pri) AS g2, count(*) AS n
    FROM (
      SELECT cast(date_trunc('month', o_orderdate) as date) AS d, n_nationkey AS nk, n_regionkey AS rk,
             n_name AS nm, c_mktsegment AS seg, o_orderpriority AS pri
      FROM {orders}
      JOIN {customer} ON o_custkey = c_custkey
      JOIN {nation} ON c_nationkey = n_nationkey
    ) j
    GROUP BY GROUPING SETS ((d, nk, rk, nm), (d, nk, rk, nm, seg), (d, nk, rk, nm, seg, pri))
  ) g
) l
""",
)

# inventory: one row per (part, warehouse 1..4).
INVENTORY_DUCKDB = """
SELECT p_partkey AS product_id, wid AS warehouse_id,
       (p_partkey * 7 + wid * 13) % 50 AS inventory_level, 10 AS reorder_point
FROM part, unnest([1, 2, 3, 4]) AS w(wid)
"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    return part.withColumn("wid", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]))).select(
        F.col("p_partkey").alias("product_id"),
        F.col("wid").alias("warehouse_id"),
        F.expr("(p_partkey * 7 + wid * 13) % 50").alias("inventory_level"),
        F.lit(10).alias("reorder_point"),
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The reference-shaped table ``name`` as a lazy DataFrame."""
    if name == "inventory":
        return _inventory(spark, sf_dir)
    adapter = ADAPTERS[name]
    frames = {t: read_table(spark, sf_dir, t) for t in adapter.tables}
    return spark.sql(adapter.sql, **frames)


def duckdb_sql(name: str) -> str:
    """The same adapter as a DuckDB statement over the pre-registered views."""
    if name == "inventory":
        return INVENTORY_DUCKDB.strip()
    adapter = ADAPTERS[name]
    return adapter.sql.format(**{t: t for t in adapter.tables})


ALL_ADAPTERS = tuple(ADAPTERS) + ("inventory",)
