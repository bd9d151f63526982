"""DuckDB statements that compute each job independently of Spark.

Each statement starts from the pre-registered test tables, derives the
reference-shaped inputs with the shared adapter text (as ``ref_<name>``), and
then states the job in plain SQL with the decisions documented in the jobs
(parameters, tie-breaks, grain). Column names and types are aligned with the
Spark output.

Thresholds, labels and output names in ``SCORED``, ``SEG``, ``CB``, ``C360``
and ``CRFM`` are fixed values that must equal the original queries'.

Each statement has the form that says most plainly what the job means:

* ``OH`` counts an order's sessions by a subquery on that order, because the
  number is defined per order;
* ``PREDICTIVE`` numbers a user's purchases from the last one, because "the
  category of the last purchase" is a first row of an order, ties included;
* ``LEAF`` names the finest level of a (date, country) first and then takes the
  rows of that level, because these are the two sentences of the job;
* ``GEO`` ranks names by revenue once per kind, because category and brand are
  the same question.

``tests/test_brute_force.py`` checks these four pair by pair in plain Python, in
no shared form.
"""

from __future__ import annotations

from tessera.plans.params import DEFAULT
from tessera.sources.adapters import duckdb_sql

P = DEFAULT
AS_OF = f"DATE '{P.as_of.isoformat()}'"
TX_START = f"TIMESTAMP '{P.tx_start.isoformat()} 00:00:00'"
TX_END = f"TIMESTAMP '{P.tx_end_exclusive.isoformat()} 00:00:00'"
O_START = f"DATE '{P.order_start.isoformat()}'"
O_END = f"DATE '{P.order_end.isoformat()}'"
TILES = P.customer_segment_count
LOOKBACK = P.lookback_days


def _with(adapters: list[str], ctes: list[tuple[str, str]], body: str) -> str:
    parts = [f"ref_{a} AS (\n{duckdb_sql(a)}\n)" for a in adapters]
    parts += [f"{name} AS (\n{sql.strip()}\n)" for name, sql in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def mode_sql(src: str, keys: list[str], col: str, out: str, count_nulls: bool = True) -> str:
    """Most frequent value per group; ties -> lowest value, NULL counted and last."""
    k = ", ".join(keys)
    where = "" if count_nulls else f"WHERE {col} IS NOT NULL"
    return f"""
SELECT {k}, v AS {out} FROM (
  SELECT {k}, v, row_number() OVER (PARTITION BY {k} ORDER BY c DESC, v ASC NULLS LAST) AS rn
  FROM (SELECT {k}, {col} AS v, count(*) AS c FROM {src} {where} GROUP BY {k}, {col}) counted
) ranked WHERE rn = 1"""


# ---------------------------------------------------------------- customer-360 model
RAW = f"""
SELECT transaction_id, user_id,
  strptime(transaction_time, '%Y-%m-%d %H:%M:%S') AS transaction_time,
  product_id, product_category, quantity, unit_price,
  cast(quantity * unit_price AS DECIMAL(38,4)) AS total_price,
  payment_method, shipping_country,
  CASE WHEN device_type IN ('mobile', 'tablet') THEN 'mobile'
       WHEN device_type = 'desktop' THEN 'desktop' ELSE 'other' END AS device_type_clean,
  is_return
FROM ref_transactions
WHERE strptime(transaction_time, '%Y-%m-%d %H:%M:%S') >= {TX_START}
  AND strptime(transaction_time, '%Y-%m-%d %H:%M:%S') < {TX_END}
  AND is_test_transaction = FALSE
"""

META = f"""
SELECT t.*, a.most_used_payment_method, b.most_common_shipping_country, c.most_common_device_type
FROM (
  SELECT user_id,
    min(transaction_time) AS first_purchase_date,
    max(transaction_time) AS last_purchase_date,
    count(DISTINCT transaction_id) AS total_transactions,
    cast(sum(CASE WHEN is_return THEN 0 ELSE total_price END) AS DECIMAL(38,4)) AS total_spend,
    cast(sum(CASE WHEN is_return THEN 0 ELSE 1 END) AS BIGINT) AS total_purchases,
    cast(sum(CASE WHEN is_return THEN quantity ELSE 0 END) AS BIGINT) AS total_items_returned,
    count(DISTINCT product_category) AS distinct_categories_purchased,
    count(DISTINCT cast(transaction_time AS DATE)) AS distinct_purchase_days
  FROM raw GROUP BY user_id
) t
LEFT JOIN ({mode_sql('raw', ['user_id'], 'payment_method', 'most_used_payment_method')}) a USING (user_id)
LEFT JOIN ({mode_sql('raw', ['user_id'], 'shipping_country', 'most_common_shipping_country')}) b USING (user_id)
LEFT JOIN ({mode_sql('raw', ['user_id'], 'device_type_clean', 'most_common_device_type')}) c USING (user_id)
"""

SCORED = f"""
SELECT *, rs + fs + ms AS rfm_total_score FROM (
  SELECT *,
    CASE WHEN recency_days <= 30 THEN 5 WHEN recency_days <= 60 THEN 4 WHEN recency_days <= 90 THEN 3
         WHEN recency_days <= 180 THEN 2 ELSE 1 END AS rs,
    CASE WHEN total_transactions >= 20 THEN 5 WHEN total_transactions >= 10 THEN 4
         WHEN total_transactions >= 5 THEN 3 WHEN total_transactions >= 2 THEN 2 ELSE 1 END AS fs,
    CASE WHEN total_spend >= 1000 THEN 5 WHEN total_spend >= 500 THEN 4 WHEN total_spend >= 200 THEN 3
         WHEN total_spend >= 50 THEN 2 ELSE 1 END AS ms
  FROM (SELECT *, cast(date_diff('day', cast(last_purchase_date AS DATE), {AS_OF}) AS INTEGER) AS recency_days
        FROM meta) d
) s
"""

META_COLS = (
    "first_purchase_date, last_purchase_date, total_transactions, total_spend, total_purchases, "
    "total_items_returned, distinct_categories_purchased, distinct_purchase_days, most_used_payment_method, "
    "most_common_shipping_country, most_common_device_type"
)

SEG = f"""
SELECT user_id, recency_days, total_transactions AS frequency, total_spend AS monetary,
  rs AS recency_score, fs AS frequency_score, ms AS monetary_score, rfm_total_score,
  {META_COLS},
  CASE WHEN rfm_total_score >= 13 THEN 'Champions'
       WHEN rfm_total_score >= 11 THEN 'Loyal Customers'
       WHEN rfm_total_score >= 9 THEN 'Potential Loyalists'
       WHEN rs >= 4 THEN 'New Customers'
       WHEN rs <= 2 AND fs >= 3 THEN 'At Risk'
       WHEN rs <= 2 AND fs <= 2 THEN 'Hibernating'
       WHEN ms >= 4 THEN 'Big Spenders'
       ELSE 'Need Attention' END AS customer_segment
FROM scored
"""

PM = """
SELECT product_id, product_category,
  count(DISTINCT user_id) AS unique_customers,
  cast(sum(quantity) AS BIGINT) AS total_quantity_sold,
  cast(sum(total_price) AS DECIMAL(38,4)) AS total_revenue,
  cast(sum(CASE WHEN is_return THEN quantity ELSE 0 END) AS BIGINT) AS total_quantity_returned,
  cast(sum(CASE WHEN is_return THEN total_price ELSE 0 END) AS DECIMAL(38,4)) AS total_revenue_returned,
  count(DISTINCT transaction_id) AS transaction_count,
  cast(sum(quantity) AS DOUBLE) / count(quantity) AS avg_quantity_per_transaction,
  cast(sum(total_price) AS DOUBLE) / count(total_price) AS avg_revenue_per_transaction,
  cast(sum(CASE WHEN is_return THEN quantity ELSE 0 END) AS DOUBLE) / cast(sum(quantity) AS DOUBLE) AS return_rate,
  count(DISTINCT CASE WHEN device_type_clean = 'mobile' THEN user_id END) AS mobile_customers,
  count(DISTINCT CASE WHEN device_type_clean = 'desktop' THEN user_id END) AS desktop_customers
FROM raw GROUP BY product_id, product_category
"""

CM = """
SELECT product_category,
  count(DISTINCT product_id) AS unique_products,
  cast(sum(total_quantity_sold) AS BIGINT) AS category_quantity_sold,
  cast(sum(total_revenue) AS DECIMAL(38,4)) AS category_revenue,
  cast(sum(total_quantity_returned) AS BIGINT) AS category_quantity_returned,
  cast(sum(total_revenue_returned) AS DECIMAL(38,4)) AS category_revenue_returned,
  cast(sum(unique_customers) AS BIGINT) AS category_unique_customers,
  cast(sum(transaction_count) AS BIGINT) AS category_transaction_count,
  floor(avg(avg_quantity_per_transaction) * 1000000 + 0.5) / 1000000 AS category_avg_quantity,
  floor(avg(avg_revenue_per_transaction) * 1000000 + 0.5) / 1000000 AS category_avg_revenue,
  cast(sum(total_quantity_returned) AS DOUBLE) / cast(sum(total_quantity_sold) AS DOUBLE) AS category_return_rate,
  floor(quantile_cont(avg_revenue_per_transaction, 0.5) * 1000000 + 0.5) / 1000000 AS median_revenue_per_transaction
FROM pm GROUP BY product_category
"""

SEQ = """
SELECT user_id,
  row_number() OVER w AS step,
  lead(product_category) OVER w AS next_category,
  product_category AS current_category,
  lead(transaction_time) OVER w AS next_purchase_time,
  transaction_time AS current_purchase_time,
  cast(date_diff('day', cast(transaction_time AS DATE), cast(lead(transaction_time) OVER w AS DATE)) AS INTEGER)
    AS days_to_next_purchase
FROM raw WHERE NOT is_return
WINDOW w AS (PARTITION BY user_id ORDER BY transaction_time, transaction_id, product_id, total_price)
"""

PATTERNS = f"""
SELECT m.user_id, g.avg_days_between_purchases, n.most_common_next_category
FROM meta m
LEFT JOIN (SELECT user_id,
             cast(sum(days_to_next_purchase) AS DOUBLE) / count(days_to_next_purchase) AS avg_days_between_purchases
           FROM seq GROUP BY user_id) g ON g.user_id = m.user_id
LEFT JOIN ({mode_sql('seq', ['user_id'], 'next_category', 'most_common_next_category', count_nulls=False)}) n
  ON n.user_id = m.user_id
"""

COHORTS = """
SELECT g.cohort_month, s.cohort_size, g.months_since_cohort, g.retained_users,
  floor((g.retained_users / s.cohort_size * 100) * 100 + 0.5) / 100 AS retention_rate,
  g.total_spend,
  cast(cast((cast(g.total_spend * 10000 AS HUGEINT) * 2 + s.cohort_size * 100) // (s.cohort_size * 200)
            AS DECIMAL(18,0)) * 0.01 AS DECIMAL(38,2)) AS avg_spend_per_user,
  g.total_orders,
  floor((g.total_orders / s.cohort_size) * 100 + 0.5) / 100 AS avg_orders_per_user
FROM (
  SELECT c.cohort_month,
    cast((year(r.transaction_time) * 12 + month(r.transaction_time))
         - (year(c.cohort_month) * 12 + month(c.cohort_month)) AS INTEGER) AS months_since_cohort,
    count(DISTINCT r.user_id) AS retained_users,
    cast(sum(r.total_price) AS DECIMAL(38,4)) AS total_spend,
    count(DISTINCT r.transaction_id) AS total_orders
  FROM raw r JOIN cohort_of c ON r.user_id = c.user_id
  WHERE NOT r.is_return
  GROUP BY 1, 2
  HAVING months_since_cohort >= 0
) g
JOIN (SELECT cohort_month, count(*) AS cohort_size FROM cohort_of GROUP BY cohort_month) s USING (cohort_month)
"""

COHORT_OF = "SELECT user_id, cast(date_trunc('month', cast(first_purchase_date AS DATE)) AS DATE) AS cohort_month FROM meta"

PREDICTIVE = f"""
SELECT s.user_id, s.customer_segment, s.last_purchase_date, s.total_spend, s.total_transactions,
  CASE WHEN s.recency_days > 180 THEN 'High Risk' WHEN s.recency_days > 90 THEN 'Medium Risk'
       WHEN s.recency_days > 30 THEN 'Low Risk' ELSE 'Active' END AS churn_risk,
  cast(cast(s.last_purchase_date AS DATE)
       + cast(round(coalesce(p.avg_days_between_purchases,
                             CASE WHEN s.total_transactions = 1 THEN 90 ELSE 30 END)) AS INTEGER) AS DATE)
    AS predicted_next_purchase_date,
  coalesce(p.most_common_next_category,
           CASE WHEN s.total_transactions = 1 THEN lastcat.product_category END) AS predicted_next_category,
  cast(s.total_spend * CASE WHEN s.customer_segment = 'Champions' THEN 1.5
                            WHEN s.customer_segment = 'Loyal Customers' THEN 1.2
                            WHEN s.customer_segment = 'Potential Loyalists' THEN 1.1
                            WHEN s.customer_segment = 'New Customers' THEN 0.8
                            ELSE 0.5 END AS DECIMAL(38,5)) AS projected_lifetime_value
FROM seg s
LEFT JOIN patterns p ON p.user_id = s.user_id
LEFT JOIN (
  SELECT user_id, product_category FROM (
    SELECT user_id, product_category,
           row_number() OVER (PARTITION BY user_id ORDER BY transaction_time DESC, transaction_id DESC,
                                                          product_id DESC, total_price DESC) AS latest
    FROM raw
  ) ordered WHERE latest = 1
) lastcat ON lastcat.user_id = s.user_id
"""

PRIMARY = """
SELECT user_id, product_id, product_category FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY net DESC, product_id, product_category) AS rn
  FROM (SELECT user_id, product_id, product_category,
               sum(CASE WHEN is_return THEN 0 ELSE total_price END) AS net
        FROM raw GROUP BY user_id, product_id, product_category) n
) r WHERE rn = 1
"""

C360 = f"""
SELECT u.user_id, u.first_purchase_date, u.last_purchase_date, u.total_transactions, u.total_spend,
  u.total_purchases, u.total_items_returned, u.distinct_categories_purchased, u.distinct_purchase_days,
  u.most_used_payment_method, u.most_common_shipping_country, u.most_common_device_type, u.customer_segment,
  u.recency_days, u.frequency, u.monetary, u.recency_score, u.frequency_score, u.monetary_score, u.rfm_total_score,
  p.unique_customers AS products_unique_customers, p.total_quantity_sold AS products_total_quantity_sold,
  p.total_revenue AS products_total_revenue, p.total_quantity_returned AS products_total_quantity_returned,
  p.total_revenue_returned AS products_total_revenue_returned, p.transaction_count AS products_transaction_count,
  p.avg_quantity_per_transaction AS products_avg_quantity, p.avg_revenue_per_transaction AS products_avg_revenue,
  p.return_rate AS products_return_rate,
  c.unique_products AS category_unique_products, c.category_quantity_sold, c.category_revenue,
  c.category_quantity_returned, c.category_revenue_returned, c.category_unique_customers,
  c.category_transaction_count, c.category_avg_quantity, c.category_avg_revenue, c.category_return_rate,
  c.median_revenue_per_transaction,
  pt.avg_days_between_purchases, pt.most_common_next_category,
  mc.cohort_month, mc.cohort_size, mc.months_since_cohort, mc.retained_users, mc.retention_rate,
  mc.total_spend AS cohort_total_spend, mc.avg_spend_per_user, mc.total_orders AS cohort_total_orders,
  mc.avg_orders_per_user,
  pr.churn_risk, pr.predicted_next_purchase_date, pr.predicted_next_category, pr.projected_lifetime_value,
  CASE WHEN u.total_transactions = 0 THEN NULL ELSE cast(u.total_spend AS DOUBLE) / u.total_transactions END
    AS avg_spend_per_transaction,
  CASE WHEN u.distinct_purchase_days = 0 THEN NULL ELSE cast(u.total_spend AS DOUBLE) / u.distinct_purchase_days END
    AS avg_spend_per_day,
  CASE WHEN u.total_purchases = 0 THEN NULL ELSE cast(u.total_items_returned AS DOUBLE) / u.total_purchases END
    AS return_rate,
  cast(date_diff('day', cast(u.first_purchase_date AS DATE), {AS_OF}) AS INTEGER) AS days_since_first_purchase,
  CASE WHEN u.span = 0 THEN 0.0 ELSE cast(u.total_spend AS DOUBLE) / u.span * 30 END AS monthly_spend_rate,
  CASE WHEN month(u.last_purchase_date) IN (11, 12) THEN 'Holiday Season'
       WHEN month(u.last_purchase_date) IN (6, 7) THEN 'Summer Season' ELSE 'Regular Season' END
    AS last_purchase_season,
  CASE WHEN u.total_spend >= 1000 THEN 'Platinum' WHEN u.total_spend >= 500 THEN 'Gold'
       WHEN u.total_spend >= 200 THEN 'Silver' ELSE 'Bronze' END AS value_tier,
  CASE WHEN u.distinct_categories_purchased >= 5 THEN 'Multi-Category'
       WHEN u.distinct_categories_purchased >= 3 THEN 'Several Categories'
       WHEN u.distinct_categories_purchased = 2 THEN 'Two Categories' ELSE 'Single Category' END
    AS category_behavior
FROM (
  SELECT s.*,
    cast(date_trunc('month', cast(first_purchase_date AS DATE)) AS DATE) AS c_month,
    cast((year(last_purchase_date) * 12 + month(last_purchase_date))
         - (year(first_purchase_date) * 12 + month(first_purchase_date)) AS INTEGER) AS c_offset,
    date_diff('day', cast(first_purchase_date AS DATE), cast(last_purchase_date AS DATE)) AS span
  FROM seg s
) u
LEFT JOIN primary_product pp ON pp.user_id = u.user_id
LEFT JOIN pm p ON p.product_id = pp.product_id AND p.product_category = pp.product_category
LEFT JOIN cm c ON c.product_category = pp.product_category
LEFT JOIN patterns pt ON pt.user_id = u.user_id
LEFT JOIN cohorts mc ON mc.cohort_month = u.c_month AND mc.months_since_cohort = u.c_offset
LEFT JOIN predictive pr ON pr.user_id = u.user_id
ORDER BY u.total_spend DESC, u.total_transactions DESC, u.user_id
LIMIT {P.top_limit}
"""

TX = ["transactions"]
C1_BASE = [("raw", RAW)]
C1_META = C1_BASE + [("meta", META)]
C1_SEG = C1_META + [("scored", SCORED), ("seg", SEG)]
C1_PM = C1_BASE + [("pm", PM)]
C1_PATTERNS = C1_META + [("seq", SEQ), ("patterns", PATTERNS)]
C1_ALL = C1_SEG + [
    ("pm", PM), ("cm", CM), ("seq", SEQ), ("patterns", PATTERNS), ("cohort_of", COHORT_OF),
    ("cohorts", COHORTS), ("predictive", PREDICTIVE), ("primary_product", PRIMARY),
]

TIME_ANALYSIS = f"""
SELECT d.*, a.top_category, b.top_payment_method FROM (
  SELECT transaction_date,
    cast(weekofyear(transaction_date) AS INTEGER) AS week_of_year,
    cast(month(transaction_date) AS INTEGER) AS month_of_year,
    cast(quarter(transaction_date) AS INTEGER) AS quarter_of_year,
    count(DISTINCT transaction_id) AS daily_transactions,
    count(DISTINCT user_id) AS daily_customers,
    cast(sum(total_price) AS DECIMAL(38,4)) AS daily_revenue,
    cast(sum(CASE WHEN is_return THEN 0 ELSE total_price END) AS DECIMAL(38,4)) AS daily_net_revenue,
    cast(sum(CASE WHEN is_return THEN total_price ELSE 0 END) AS DECIMAL(38,4)) AS daily_returns,
    cast(sum(CASE WHEN is_return THEN 0 ELSE quantity END) AS BIGINT) AS daily_quantity_sold,
    cast(sum(CASE WHEN is_return THEN 0 ELSE total_price END) AS DOUBLE)
      / count(CASE WHEN is_return THEN 0 ELSE total_price END) AS avg_order_value,
    count(DISTINCT CASE WHEN device_type_clean = 'mobile' THEN user_id END) AS mobile_customers,
    count(DISTINCT CASE WHEN device_type_clean = 'desktop' THEN user_id END) AS desktop_customers
  FROM days GROUP BY transaction_date
) d
LEFT JOIN ({mode_sql('days', ['transaction_date'], 'product_category', 'top_category')}) a USING (transaction_date)
LEFT JOIN ({mode_sql('days', ['transaction_date'], 'payment_method', 'top_payment_method')}) b USING (transaction_date)
"""

# ---------------------------------------------------------------- order model
CB = f"""
SELECT c.customer_id, c.first_name, c.last_name, c.email, c.registration_date, c.country, c.city, c.postal_code,
  cast(date_diff('day', c.registration_date, {AS_OF}) AS INTEGER) AS customer_tenure_days,
  CASE WHEN c.registration_date >= {AS_OF} - INTERVAL 30 DAY THEN 'New'
       WHEN c.registration_date BETWEEN {AS_OF} - INTERVAL 365 DAY AND {AS_OF} - INTERVAL 30 DAY THEN 'Regular'
       ELSE 'Loyal' END AS customer_category,
  coalesce(cs.subscription_tier, 'None') AS subscription_tier,
  cs.subscription_start_date,
  cs.subscription_end_date,
  cast(coalesce(cs.monthly_fee, 0) AS DECIMAL(18,2)) AS subscription_monthly_fee
FROM ref_customers c
LEFT JOIN ref_customer_subscriptions cs
  ON c.customer_id = cs.customer_id
 AND {AS_OF} BETWEEN cs.subscription_start_date AND coalesce(cs.subscription_end_date, DATE '9999-12-31')
"""

OH = f"""
SELECT o.order_id, o.customer_id, o.order_date, o.total_amount, o.discount_amount, o.shipping_cost, o.tax_amount,
  cast(o.total_amount - o.discount_amount + o.shipping_cost + o.tax_amount AS DECIMAL(38,2)) AS final_amount,
  o.payment_method, o.order_status, o.delivery_address_id, o.shipping_method,
  o.estimated_delivery_date, o.actual_delivery_date,
  CASE WHEN o.actual_delivery_date IS NOT NULL
       THEN cast(date_diff('day', o.order_date, o.actual_delivery_date) AS INTEGER) END AS delivery_time_days,
  CASE WHEN o.actual_delivery_date IS NOT NULL AND o.estimated_delivery_date IS NOT NULL
       THEN cast(date_diff('day', o.estimated_delivery_date, o.actual_delivery_date) AS INTEGER) END
    AS delivery_delay_days,
  CASE WHEN o.order_status = 'Cancelled' THEN 1 ELSE 0 END AS is_cancelled,
  CASE WHEN o.order_status = 'Returned' THEN 1 ELSE 0 END AS is_returned,
  date_sub('minute', o.cart_creation_timestamp, o.order_timestamp) AS decision_time_minutes,
  (SELECT count(DISTINCT se.session_id) FROM ref_user_sessions se
   WHERE se.customer_id = o.customer_id
     AND se.session_timestamp BETWEEN o.order_timestamp - INTERVAL {LOOKBACK} DAY AND o.order_timestamp
  ) AS sessions_before_purchase
FROM ref_orders o
WHERE o.order_date BETWEEN {O_START} AND {O_END}
"""

NET_UNIT = "(oi.unit_price * (100 - oi.discount_percentage) * 0.01)"
OID = f"""
SELECT oi.order_id, oi.product_id, oi.quantity, oi.unit_price, oi.discount_percentage,
  cast(oi.unit_price * oi.quantity AS DECIMAL(38,2)) AS gross_item_amount,
  cast(oi.unit_price * oi.quantity * (100 - oi.discount_percentage) * 0.01 AS DECIMAL(38,4)) AS net_item_amount,
  p.product_name, p.category_id, p.subcategory_id, p.brand_id, p.supplier_id, p.unit_cost,
  cast(({NET_UNIT} - p.unit_cost) * oi.quantity AS DECIMAL(38,4)) AS item_profit,
  cast({NET_UNIT} - p.unit_cost AS DOUBLE) / cast(p.unit_cost AS DOUBLE) * 100 AS profit_margin_percentage,
  cast(p.weight_kg * oi.quantity AS DECIMAL(38,1)) AS total_weight_kg,
  p.is_perishable, p.shelf_life_days,
  pc.category_name, psc.subcategory_name, b.brand_name, s.supplier_name, s.country AS supplier_country
FROM ref_order_items oi
JOIN ref_products p ON oi.product_id = p.product_id
JOIN ref_product_categories pc ON p.category_id = pc.category_id
JOIN ref_product_subcategories psc ON p.subcategory_id = psc.subcategory_id
JOIN ref_brands b ON p.brand_id = b.brand_id
JOIN ref_suppliers s ON p.supplier_id = s.supplier_id
JOIN oh ON oi.order_id = oh.order_id
"""

COP = f"""
SELECT b.* EXCLUDE (days),
  coalesce(x.unique_products_purchased, 0) AS unique_products_purchased,
  coalesce(x.unique_categories_purchased, 0) AS unique_categories_purchased,
  CASE WHEN b.days <= 30 THEN 'Active' WHEN b.days BETWEEN 31 AND 90 THEN 'At Risk'
       WHEN b.days BETWEEN 91 AND 180 THEN 'Lapsed' ELSE 'Churned' END AS recency_segment,
  cast(ntile({TILES}) OVER (ORDER BY b.total_spent ASC, b.customer_id) AS INTEGER) AS monetary_segment,
  cast(ntile({TILES}) OVER (ORDER BY b.total_orders ASC, b.customer_id) AS INTEGER) AS frequency_segment
FROM (
  SELECT customer_id,
    count(DISTINCT order_id) AS total_orders,
    cast(sum(final_amount) AS DECIMAL(38,2)) AS total_spent,
    cast(sum(final_amount) AS DOUBLE) / count(final_amount) AS average_order_value,
    min(order_date) AS first_purchase_date,
    max(order_date) AS last_purchase_date,
    cast(date_diff('day', min(order_date), max(order_date)) AS INTEGER) AS customer_lifespan_days,
    date_diff('day', min(order_date), max(order_date)) / nullif(count(DISTINCT order_id) - 1, 0)
      AS average_days_between_orders,
    cast(sum(CASE WHEN is_cancelled = 1 THEN 1 ELSE 0 END) AS BIGINT) AS cancelled_orders,
    cast(sum(CASE WHEN is_returned = 1 THEN 1 ELSE 0 END) AS BIGINT) AS returned_orders,
    list_sort(list_distinct(list(payment_method))) AS payment_methods_used,
    date_diff('day', max(order_date), {AS_OF}) AS days
  FROM oh GROUP BY customer_id
) b
LEFT JOIN (
  SELECT o.customer_id,
    count(DISTINCT i.product_id) AS unique_products_purchased,
    count(DISTINCT i.category_id) AS unique_categories_purchased
  FROM oid i JOIN oh o ON i.order_id = o.order_id
  GROUP BY o.customer_id
) x ON x.customer_id = b.customer_id
"""

PP = f"""
SELECT s.*, r.average_rating, coalesce(r.review_count, 0) AS review_count, st.low_stock_warehouses,
  cast(rank() OVER (PARTITION BY s.category_id ORDER BY s.net_revenue DESC) AS INTEGER) AS category_revenue_rank,
  percent_rank() OVER (ORDER BY s.net_revenue DESC) AS overall_revenue_percentile
FROM (
  SELECT i.product_id, i.product_name, i.category_id, i.category_name, i.subcategory_id, i.subcategory_name,
    i.brand_id, i.brand_name, i.supplier_id, i.supplier_name,
    count(DISTINCT i.order_id) AS order_count,
    cast(sum(i.quantity) AS BIGINT) AS total_quantity_sold,
    cast(sum(i.gross_item_amount) AS DECIMAL(38,2)) AS gross_revenue,
    cast(sum(i.net_item_amount) AS DECIMAL(38,4)) AS net_revenue,
    cast(sum(i.item_profit) AS DECIMAL(38,4)) AS total_profit,
    floor(avg(i.profit_margin_percentage) * 1000000 + 0.5) / 1000000 AS average_profit_margin,
    count(DISTINCT o.customer_id) AS unique_customers
  FROM oid i JOIN oh o ON i.order_id = o.order_id
  GROUP BY i.product_id, i.product_name, i.category_id, i.category_name, i.subcategory_id, i.subcategory_name,
    i.brand_id, i.brand_name, i.supplier_id, i.supplier_name
) s
LEFT JOIN (
  SELECT product_id, cast(sum(review_rating) AS DOUBLE) / count(review_rating) AS average_rating,
    count(*) AS review_count
  FROM ref_product_reviews WHERE review_date BETWEEN {O_START} AND {O_END} GROUP BY product_id
) r ON r.product_id = s.product_id
LEFT JOIN (
  SELECT product_id,
    cast(sum(CASE WHEN inventory_level <= reorder_point THEN 1 ELSE 0 END) AS BIGINT) AS low_stock_warehouses
  FROM ref_inventory
  WHERE warehouse_id IN (SELECT warehouse_id FROM ref_warehouses WHERE is_active = TRUE)
  GROUP BY product_id
) st ON st.product_id = s.product_id
"""

TBS = """
SELECT month, category_id, category_name, monthly_revenue, monthly_order_count, monthly_customer_count,
  monthly_units_sold, monthly_profit,
  lag(monthly_revenue) OVER (PARTITION BY category_id ORDER BY month) AS prev_month_revenue,
  CASE WHEN lag(monthly_revenue) OVER (PARTITION BY category_id ORDER BY month) IS NOT NULL THEN
    cast(monthly_revenue - lag(monthly_revenue) OVER (PARTITION BY category_id ORDER BY month) AS DOUBLE)
    / nullif(cast(lag(monthly_revenue) OVER (PARTITION BY category_id ORDER BY month) AS DOUBLE), 0) * 100
  END AS month_over_month_growth,
  cast(sum(monthly_revenue) OVER (PARTITION BY category_id ORDER BY month
                                  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE)
    / count(monthly_revenue) OVER (PARTITION BY category_id ORDER BY month
                                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three_month_moving_avg,
  cast(sum(monthly_revenue) OVER (PARTITION BY category_id ORDER BY month
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,4))
    AS cumulative_revenue
FROM (
  SELECT cast(date_trunc('month', o.order_date) AS DATE) AS month, i.category_id, i.category_name,
    cast(sum(i.net_item_amount) AS DECIMAL(38,4)) AS monthly_revenue,
    count(DISTINCT o.order_id) AS monthly_order_count,
    count(DISTINCT o.customer_id) AS monthly_customer_count,
    cast(sum(i.quantity) AS BIGINT) AS monthly_units_sold,
    cast(sum(i.item_profit) AS DECIMAL(38,4)) AS monthly_profit
  FROM oh o JOIN oid i ON o.order_id = i.order_id
  GROUP BY 1, 2, 3
) m
"""


def _geo_top(name: str, out: str) -> str:
    """Per (country, city): the name with the most net revenue, lowest name on ties."""
    return f"""
SELECT country, city, {name} AS {out} FROM (
  SELECT cb.country, cb.city, i.{name},
         row_number() OVER (PARTITION BY cb.country, cb.city
                            ORDER BY sum(i.net_item_amount) DESC, i.{name}) AS pick
  FROM oid i JOIN oh ON i.order_id = oh.order_id JOIN cb ON oh.customer_id = cb.customer_id
  WHERE cb.country IS NOT NULL AND cb.city IS NOT NULL
  GROUP BY cb.country, cb.city, i.{name}
) ranked WHERE pick = 1"""


GEO = f"""
SELECT t.*, tc.top_category, tb.top_brand
FROM (
  SELECT cb.country, cb.city,
    count(DISTINCT oh.order_id) AS total_orders,
    count(DISTINCT oh.customer_id) AS total_customers,
    cast(sum(oh.final_amount) AS DECIMAL(38,2)) AS total_revenue,
    cast(sum(oh.final_amount) AS DOUBLE) / count(oh.final_amount) AS average_order_value,
    cast(sum(oh.shipping_cost) AS DECIMAL(38,2)) AS total_shipping_cost,
    cast(sum(oh.shipping_cost) AS DOUBLE) / count(oh.shipping_cost) AS average_shipping_cost,
    cast(sum(CASE WHEN oh.delivery_delay_days > 0 THEN 1 ELSE 0 END) AS BIGINT) AS delayed_deliveries,
    cast(sum(CASE WHEN oh.delivery_delay_days > 0 THEN oh.delivery_delay_days END) AS DOUBLE)
      / count(CASE WHEN oh.delivery_delay_days > 0 THEN oh.delivery_delay_days END) AS average_delay_days
  FROM cb JOIN oh ON cb.customer_id = oh.customer_id
  GROUP BY cb.country, cb.city
) t
LEFT JOIN ({_geo_top('category_name', 'top_category')}) tc ON tc.country = t.country AND tc.city = t.city
LEFT JOIN ({_geo_top('brand_name', 'top_brand')}) tb ON tb.country = t.country AND tb.city = t.city
"""

CRFM = f"""
SELECT c.customer_id, c.recency_segment, c.frequency_segment, c.monetary_segment,
  concat(c.recency_segment, '-', cast(c.frequency_segment AS VARCHAR), '-', cast(c.monetary_segment AS VARCHAR))
    AS rfm_segment,
  CASE WHEN c.recency_segment = 'Active' AND c.monetary_segment >= 4 AND c.frequency_segment >= 4 THEN 'Champions'
       WHEN c.recency_segment = 'Active' AND c.monetary_segment >= 3 AND c.frequency_segment >= 3
         THEN 'Loyal Customers'
       WHEN c.recency_segment = 'Active' AND c.monetary_segment <= 2 AND c.frequency_segment <= 2 THEN 'Promising'
       WHEN c.recency_segment = 'At Risk' AND c.monetary_segment >= 4 AND c.frequency_segment >= 4
         THEN 'At Risk Champions'
       WHEN c.recency_segment IN ('Lapsed', 'Churned') AND c.monetary_segment >= 4 AND c.frequency_segment >= 4
         THEN 'Lost Champions'
       WHEN c.recency_segment IN ('Lapsed', 'Churned') AND c.monetary_segment <= 2 AND c.frequency_segment <= 2
         THEN 'Lost Cause'
       ELSE 'Needs Attention' END AS customer_segment,
  c.total_orders, c.total_spent, c.average_order_value, c.first_purchase_date, c.last_purchase_date,
  c.customer_lifespan_days, c.average_days_between_orders, c.cancelled_orders, c.returned_orders,
  c.unique_products_purchased, c.unique_categories_purchased,
  r.average_review_rating, coalesce(r.review_count, 0) AS review_count,
  coalesce(t.support_ticket_count, 0) AS support_ticket_count, t.average_satisfaction_score
FROM cop c
LEFT JOIN (
  SELECT customer_id, cast(sum(review_rating) AS DOUBLE) / count(review_rating) AS average_review_rating,
    count(*) AS review_count
  FROM ref_product_reviews WHERE review_date BETWEEN {O_START} AND {O_END} GROUP BY customer_id
) r ON r.customer_id = c.customer_id
LEFT JOIN (
  SELECT customer_id, count(*) AS support_ticket_count,
    cast(sum(satisfaction_score) AS DOUBLE) / count(satisfaction_score) AS average_satisfaction_score
  FROM ref_customer_support_tickets WHERE created_date BETWEEN {O_START} AND {O_END} GROUP BY customer_id
) t ON t.customer_id = c.customer_id
"""

STAR = ["order_items", "products", "product_categories", "product_subcategories", "brands", "suppliers"]
C2_OH = [("oh", OH)]
C2_OID = C2_OH + [("oid", OID)]

LEAF = """
SELECT covid.subregion1_name AS province_state, covid.country_name AS country_region, covid.date,
  latitude, longitude, subregion1_name AS sub_region1_name, location_geometry AS location_geom,
  cumulative_confirmed AS confirmed, cumulative_deceased AS deaths, cumulative_recovered AS recovered,
  cumulative_confirmed - cumulative_recovered - cumulative_deceased AS active,
  subregion2_code AS fips, subregion2_name AS admin_2, location_key AS combined_key
FROM ref_covid19_open_data covid
JOIN finest_level f ON f.date = covid.date AND f.country_code = covid.country_code
        AND f.level = covid.aggregation_level
"""

def _top_count(col: str) -> str:
    return f"SELECT user_id, max(c) AS c FROM (SELECT user_id, {col}, count(*) AS c FROM raw GROUP BY ALL) n GROUP BY user_id"


MODE_COUNTS = f"""
SELECT p.user_id, p.c AS most_used_payment_method_count, s.c AS most_common_shipping_country_count,
       d.c AS most_common_device_type_count
FROM ({_top_count('payment_method')}) p
JOIN ({_top_count('shipping_country')}) s ON s.user_id IS NOT DISTINCT FROM p.user_id
JOIN ({_top_count('device_type_clean')}) d ON d.user_id IS NOT DISTINCT FROM p.user_id
"""

ORACLE_SQL: dict[str, str] = {
    "scalar_subquery_filter": "SELECT * FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
    "leaf_level_extract": _with(
        ["covid19_open_data"],
        [
            ("finest_level", """SELECT date, country_code,
                                       CASE WHEN count(subregion2_code) > 0 THEN 2
                                            WHEN count(subregion1_code) > 0 THEN 1 ELSE 0 END AS level
                                FROM ref_covid19_open_data GROUP BY date, country_code"""),
        ],
        LEAF,
    ),
    "clean_transactions": _with(TX, C1_BASE, "SELECT * FROM raw"),
    "customer_metadata": _with(TX, C1_META, "SELECT * FROM meta"),
    "customer_modes_approx": _with(TX, C1_BASE, MODE_COUNTS),
    "rfm_scores": _with(
        TX, C1_META + [("scored", SCORED)],
        """SELECT user_id, recency_days, total_transactions AS frequency, total_spend AS monetary,
                  rs AS recency_score, fs AS frequency_score, ms AS monetary_score, rfm_total_score FROM scored""",
    ),
    "customer_segments": _with(TX, C1_SEG, "SELECT * FROM seg"),
    "product_metrics": _with(TX, C1_PM, "SELECT * FROM pm"),
    "category_metrics": _with(TX, C1_PM + [("cm", CM)], "SELECT * FROM cm"),
    "product_global_median": _with(
        TX, C1_PM,
        """SELECT pm.*, floor((SELECT quantile_cont(avg_revenue_per_transaction, 0.5) FROM pm) * 1000000 + 0.5) / 1000000
                  AS median_revenue_per_transaction FROM pm""",
    ),
    "time_analysis": _with(
        TX, C1_BASE + [("days", "SELECT *, cast(transaction_time AS DATE) AS transaction_date FROM raw")],
        TIME_ANALYSIS,
    ),
    "purchase_history": _with(
        TX, C1_BASE,
        """SELECT user_id, transaction_time, transaction_id, product_id, product_category, total_price,
                  row_number() OVER (PARTITION BY user_id ORDER BY transaction_time, transaction_id, product_id, total_price)
                    AS position
           FROM raw""",
    ),
    "purchase_sequence": _with(TX, C1_BASE + [("seq", SEQ)], "SELECT * FROM seq"),
    # pages of PAGE consecutive elements of each user's ordered array
    "purchase_pages": _with(
        TX, C1_BASE,
        f"""SELECT user_id, (position - 1) // {DEFAULT.page_size} AS page, min(position) AS first_position,
                  cast(count(*) AS INTEGER) AS n_items,
                  list(strftime(transaction_time, '%Y-%m-%d %H:%M:%S') ORDER BY position) AS transaction_times,
                  list(transaction_id ORDER BY position) AS transaction_ids,
                  list(product_id ORDER BY position) AS product_ids,
                  list(product_category ORDER BY position) AS product_categories,
                  list(cast(total_price AS DOUBLE) ORDER BY position) AS total_prices
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                             ORDER BY transaction_time, transaction_id, product_id, total_price) AS position FROM raw)
           GROUP BY 1, 2""",
    ),
    # reading the pages back gives the rows of purchase_sequence
    "purchase_sequence_unnested": _with(TX, C1_BASE + [("seq", SEQ)], "SELECT * FROM seq"),
    "user_product_pages": _with(
        TX, C1_PM,
        f"""SELECT user_id, (position - 1) // {DEFAULT.page_size} AS page, min(position) AS first_position,
                  list(product_id ORDER BY position) AS product_ids,
                  list(product_category ORDER BY position) AS product_categories,
                  list(total_quantity_sold ORDER BY position) AS quantities_sold,
                  list(cast(total_revenue AS DOUBLE) ORDER BY position) AS revenues
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY product_id, product_category) AS position
                 FROM (SELECT DISTINCT r.user_id, r.product_id, r.product_category, pm.total_quantity_sold, pm.total_revenue
                       FROM raw r JOIN pm ON r.product_id = pm.product_id AND r.product_category = pm.product_category))
           GROUP BY 1, 2""",
    ),
    "purchase_patterns": _with(TX, C1_PATTERNS, "SELECT * FROM patterns"),
    "monthly_cohorts": _with(TX, C1_META + [("cohort_of", COHORT_OF), ("cohorts", COHORTS)], "SELECT * FROM cohorts"),
    "predictive_metrics": _with(
        TX, C1_SEG + [("seq", SEQ), ("patterns", PATTERNS), ("predictive", PREDICTIVE)], "SELECT * FROM predictive"
    ),
    "user_products": _with(
        TX, C1_PM,
        """SELECT DISTINCT r.user_id, r.product_id, r.product_category, pm.total_quantity_sold, pm.total_revenue
           FROM raw r JOIN pm ON r.product_id = pm.product_id AND r.product_category = pm.product_category""",
    ),
    "customer_360": _with(TX, C1_ALL, C360),
    "customer_base": _with(["customers", "customer_subscriptions"], [("cb", CB)], "SELECT * FROM cb"),
    "order_history": _with(["orders", "user_sessions"], C2_OH, "SELECT * FROM oh"),
    "order_items_detail": _with(["orders", "user_sessions"] + STAR, C2_OID, "SELECT * FROM oid"),
    "customer_order_patterns": _with(["orders", "user_sessions"] + STAR, C2_OID + [("cop", COP)], "SELECT * FROM cop"),
    "product_performance": _with(
        ["orders", "user_sessions"] + STAR + ["product_reviews", "inventory", "warehouses"], C2_OID, PP
    ),
    "time_based_sales": _with(["orders", "user_sessions"] + STAR, C2_OID, TBS),
    "geographic_sales": _with(
        ["customers", "customer_subscriptions", "orders", "user_sessions"] + STAR, [("cb", CB)] + C2_OID, GEO
    ),
    "customer_rfm": _with(
        ["orders", "user_sessions"] + STAR + ["product_reviews", "customer_support_tickets"],
        C2_OID + [("cop", COP)],
        CRFM,
    ),
}


# Money is reported as DOUBLE (summed exactly as DECIMAL first), as in the
# registered Spark results: the DECIMAL output columns of each statement.
MONEY_COLUMNS: dict[str, list[str]] = {
    "clean_transactions": ["unit_price", "total_price"],
    "customer_metadata": ["total_spend"],
    "rfm_scores": ["monetary"],
    "customer_segments": ["monetary", "total_spend"],
    "product_metrics": ["total_revenue", "total_revenue_returned"],
    "category_metrics": ["category_revenue", "category_revenue_returned"],
    "product_global_median": ["total_revenue", "total_revenue_returned"],
    "time_analysis": ["daily_revenue", "daily_net_revenue", "daily_returns"],
    "purchase_history": ["total_price"],
    "monthly_cohorts": ["total_spend", "avg_spend_per_user"],
    "predictive_metrics": ["total_spend", "projected_lifetime_value"],
    "user_products": ["total_revenue"],
    "customer_360": [
        "total_spend", "monetary", "products_total_revenue", "products_total_revenue_returned", "category_revenue",
        "category_revenue_returned", "cohort_total_spend", "avg_spend_per_user", "projected_lifetime_value",
    ],
    "customer_base": ["subscription_monthly_fee"],
    "order_history": ["total_amount", "discount_amount", "shipping_cost", "tax_amount", "final_amount"],
    "order_items_detail": [
        "unit_price", "gross_item_amount", "net_item_amount", "unit_cost", "item_profit", "total_weight_kg",
    ],
    "customer_order_patterns": ["total_spent"],
    "product_performance": ["gross_revenue", "net_revenue", "total_profit"],
    "time_based_sales": ["monthly_revenue", "monthly_profit", "prev_month_revenue", "cumulative_revenue"],
    "geographic_sales": ["total_revenue", "total_shipping_cost"],
    "customer_rfm": ["total_spent"],
}

for _key, _cols in MONEY_COLUMNS.items():
    _casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _cols)
    ORACLE_SQL[_key] = f"SELECT * REPLACE ({_casts}) FROM (\n{ORACLE_SQL[_key]}\n) reported"
