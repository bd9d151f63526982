"""Order, product and customer jobs of the second e-commerce model.

Inputs are the reference-shaped tables (``customers``, ``orders``, ...).
The script variables of the original become parameters: ``as_of`` for
``CURRENT_DATE()``, ``start``/``end`` for the analysis window, ``tiles`` for
the number of customer segments.

Correlated scalar subqueries are rewritten as one aggregation per source
table joined on the correlation key (COUNT defaults to 0, other aggregates to
NULL); the unpartitioned NTILE / PERCENT_RANK windows use the global-sort
helpers; the 30-day session look-back uses the running-sum operator.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators.distinct import distinct_counts, with_distinct_counts
from tessera.operators.lookback import lookback_distinct_count
from tessera.operators.ranking import join_null_safe, ntile_by_value, ranked
from tessera.operators.staging import materialise

MONEY2 = "decimal(38,2)"
MONEY4 = "decimal(38,4)"
OPEN_END = dt.date(9999, 12, 31)


def _avg(col: Column) -> Column:
    return F.sum(col).cast("double") / F.count(col)


# --------------------------------------------------------------------- J14
def customer_base(
    customers: DataFrame, subscriptions: DataFrame, as_of: dt.date, dedupe_latest: bool = False
) -> DataFrame:
    """Customers with tenure, New/Regular/Loyal, and the subscription valid on
    ``as_of`` (start <= as_of <= end, open end = forever). Overlapping valid
    subscriptions repeat the customer, as the original join does, unless
    ``dedupe_latest`` keeps the one that started last (then ends last)."""
    today = F.lit(as_of)
    valid = subscriptions.filter(
        (today >= F.col("subscription_start_date"))
        & (today <= F.coalesce(F.col("subscription_end_date"), F.lit(OPEN_END)))
    )
    if dedupe_latest:
        end = F.coalesce(F.col("subscription_end_date"), F.lit(OPEN_END))
        rest = [c for c in subscriptions.columns if c != "customer_id"]
        latest = F.max(F.struct("subscription_start_date", end.alias("__end"), F.struct(*rest).alias("row")))
        valid = valid.groupBy("customer_id").agg(latest["row"].alias("row")).select("customer_id", "row.*")
    reg = F.col("registration_date")
    cutoff_30, cutoff_365 = F.date_sub(today, 30), F.date_sub(today, 365)
    category = (
        F.when(reg >= cutoff_30, "New").when(reg.between(cutoff_365, cutoff_30), "Regular").otherwise("Loyal")
    )
    return customers.join(valid, "customer_id", "left").select(
        "customer_id",
        "first_name",
        "last_name",
        "email",
        "registration_date",
        "country",
        "city",
        "postal_code",
        F.datediff(today, reg).alias("customer_tenure_days"),
        category.alias("customer_category"),
        F.coalesce(F.col("subscription_tier"), F.lit("None")).alias("subscription_tier"),
        "subscription_start_date",
        "subscription_end_date",
        F.coalesce(F.col("monthly_fee"), F.lit(0).cast("decimal(18,2)")).alias("subscription_monthly_fee"),
    )


# --------------------------------------------------------------------- J15
def order_history(
    orders: DataFrame, sessions: DataFrame, start: dt.date, end: dt.date, lookback_days: int = 30
) -> DataFrame:
    """Orders placed in [start, end] with amounts, delivery times, flags,
    decision minutes and the distinct sessions of the customer in the
    ``lookback_days`` before the order (both ends inclusive)."""
    actual, est = F.col("actual_delivery_date"), F.col("estimated_delivery_date")
    window = orders.filter(F.col("order_date").between(F.lit(start), F.lit(end)))
    detailed = window.select(
        "order_id",
        "customer_id",
        "order_date",
        "total_amount",
        "discount_amount",
        "shipping_cost",
        "tax_amount",
        (F.col("total_amount") - F.col("discount_amount") + F.col("shipping_cost") + F.col("tax_amount"))
        .cast(MONEY2)
        .alias("final_amount"),
        "payment_method",
        "order_status",
        "delivery_address_id",
        "shipping_method",
        "estimated_delivery_date",
        "actual_delivery_date",
        F.when(actual.isNotNull(), F.datediff(actual, F.col("order_date"))).alias("delivery_time_days"),
        F.when(actual.isNotNull() & est.isNotNull(), F.datediff(actual, est)).alias("delivery_delay_days"),
        F.when(F.col("order_status") == "Cancelled", 1).otherwise(0).alias("is_cancelled"),
        F.when(F.col("order_status") == "Returned", 1).otherwise(0).alias("is_returned"),
        F.expr("timestampdiff(MINUTE, cart_creation_timestamp, order_timestamp)").alias("decision_time_minutes"),
        "order_timestamp",
    )
    counted = lookback_distinct_count(
        detailed, "order_id", "customer_id", "order_timestamp",
        sessions, "session_id", "customer_id", "session_timestamp",
        lookback_days, "sessions_before_purchase",
    )
    return counted.drop("order_timestamp")


# --------------------------------------------------------------------- J16
def order_items_detail(
    items: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    subcategories: DataFrame,
    brands: DataFrame,
    suppliers: DataFrame,
    oh: DataFrame,
) -> DataFrame:
    """Star join of order lines in the window with products and dimensions.

    Lines are first reduced to the orders of the window (the most selective
    join), then joined to products and the small dimensions; join strategies
    are left to adaptive execution, which broadcasts a side only once its
    actual size is known to be under the threshold. Money is exact DECIMAL:
    ``net = gross * (100 - pct) / 100``."""
    keep = (
        items.join(oh.select("order_id", F.col("customer_id").alias("order_customer_id"), "order_date"), "order_id")
        .join(products, "product_id")
        .join(categories, "category_id")
        .join(subcategories, "subcategory_id")
        .join(brands, "brand_id")
        .join(suppliers, "supplier_id")
    )
    price, qty, pct = F.col("unit_price"), F.col("quantity"), F.col("discount_percentage")
    net_unit = price * (F.lit(100) - pct) * F.lit(0.01).cast("decimal(3,2)")
    margin_unit = net_unit - F.col("unit_cost")
    return keep.select(
        "order_id",
        "product_id",
        "quantity",
        "unit_price",
        "discount_percentage",
        (price * qty).cast(MONEY2).alias("gross_item_amount"),
        (price * qty * (F.lit(100) - pct) * F.lit(0.01).cast("decimal(3,2)")).cast(MONEY4).alias("net_item_amount"),
        "product_name",
        "category_id",
        "subcategory_id",
        "brand_id",
        "supplier_id",
        "unit_cost",
        (margin_unit * qty).cast(MONEY4).alias("item_profit"),
        (margin_unit.cast("double") / F.col("unit_cost").cast("double") * 100).alias("profit_margin_percentage"),
        (F.col("weight_kg") * qty).cast("decimal(38,1)").alias("total_weight_kg"),
        "is_perishable",
        "shelf_life_days",
        "category_name",
        "subcategory_name",
        "brand_name",
        "supplier_name",
        F.col("country").alias("supplier_country"),
        # of the order: the later jobs read them here instead of joining again
        "order_customer_id",
        "order_date",
    )


def public_items(oid: DataFrame) -> DataFrame:
    """J16's own columns."""
    return oid.drop("order_customer_id", "order_date")


# --------------------------------------------------------------------- J17
def customer_order_patterns(oh: DataFrame, oid: DataFrame, as_of: dt.date, tiles: int = 5) -> DataFrame:
    """Per customer: order counts and money, lifespan, mean gap, cancellations,
    returns, payment methods, distinct products/categories, recency label and
    NTILE segments by money and by order count (ties broken by customer id)."""
    n_orders = F.countDistinct("order_id")
    span = F.datediff(F.max("order_date"), F.min("order_date"))
    base = oh.groupBy("customer_id").agg(
        n_orders.alias("total_orders"),
        F.sum("final_amount").cast(MONEY2).alias("total_spent"),
        _avg(F.col("final_amount")).alias("average_order_value"),
        F.min("order_date").alias("first_purchase_date"),
        F.max("order_date").alias("last_purchase_date"),
        span.alias("customer_lifespan_days"),
        (span / F.nullif(n_orders - 1, F.lit(0))).alias("average_days_between_orders"),
        F.sum(F.when(F.col("is_cancelled") == 1, 1).otherwise(0)).cast("long").alias("cancelled_orders"),
        F.sum(F.when(F.col("is_returned") == 1, 1).otherwise(0)).cast("long").alias("returned_orders"),
        F.array_sort(F.collect_set("payment_method")).alias("payment_methods_used"),
        F.datediff(F.lit(as_of), F.max("order_date")).alias("__days"),
    )
    bought = distinct_counts(
        oid.select(F.col("order_customer_id").alias("customer_id"), "product_id", "category_id"),
        ["customer_id"],
        {"unique_products_purchased": "product_id", "unique_categories_purchased": "category_id"},
    )
    out = base.join(bought, "customer_id", "left").select(
        *[c for c in base.columns if c != "__days"],
        F.coalesce(F.col("unique_products_purchased"), F.lit(0)).alias("unique_products_purchased"),
        F.coalesce(F.col("unique_categories_purchased"), F.lit(0)).alias("unique_categories_purchased"),
        rules.recency_label(F.col("__days")).alias("recency_segment"),
    )
    # tiles of the narrow columns alone, joined on the key that both sides are grouped by
    narrow = materialise(base.select("customer_id", "total_spent", "total_orders"), "tiled")
    narrow = ntile_by_value(narrow, "total_spent", "customer_id", tiles, "monetary_segment")
    narrow = ntile_by_value(narrow, "total_orders", "customer_id", tiles, "frequency_segment")
    return out.join(narrow.select("customer_id", "monetary_segment", "frequency_segment"), "customer_id")


# --------------------------------------------------------------------- J18
def _in_window(col: str, start: dt.date, end: dt.date) -> Column:
    return F.col(col).between(F.lit(start), F.lit(end))


def product_performance(
    oid: DataFrame,
    reviews: DataFrame,
    inventory: DataFrame,
    warehouses: DataFrame,
    start: dt.date,
    end: dt.date,
) -> DataFrame:
    """Per product: sales, money, distinct customers, reviews in the window,
    low-stock active warehouses, revenue rank in its category and percent
    rank over all products (highest revenue = 0.0)."""
    keys = [
        "product_id", "product_name", "category_id", "category_name", "subcategory_id", "subcategory_name",
        "brand_id", "brand_name", "supplier_id", "supplier_name",
    ]
    ranks = ["category_revenue_rank", "overall_revenue_percentile"]
    sales = oid.groupBy(*keys).agg(
        F.sum("quantity").cast("long").alias("total_quantity_sold"),
        F.sum("gross_item_amount").cast(MONEY2).alias("gross_revenue"),
        F.sum("net_item_amount").cast(MONEY4).alias("net_revenue"),
        F.sum("item_profit").cast(MONEY4).alias("total_profit"),
        rules.round_half_up(F.avg("profit_margin_percentage"), 6).alias("average_profit_margin"),
    )
    # ranks of the narrow columns alone
    nets = materialise(sales.select(*keys, "net_revenue"), "nets")
    desc = [F.col("net_revenue").desc()]
    nets = ranked(nets, desc, ["net_revenue"], partition_by=["category_id"], rank="category_revenue_rank")
    nets = ranked(nets, desc, ["net_revenue"], percent_rank="overall_revenue_percentile")
    sales = with_distinct_counts(
        sales, oid, keys, {"order_count": "order_id", "unique_customers": "order_customer_id"}
    )
    sales = join_null_safe(sales, nets.drop("net_revenue"), keys).select(
        *keys, "order_count", "total_quantity_sold", "gross_revenue", "net_revenue", "total_profit",
        "average_profit_margin", "unique_customers", *ranks,
    )
    rated = (
        reviews.filter(_in_window("review_date", start, end))
        .groupBy("product_id")
        .agg(_avg(F.col("review_rating")).alias("average_rating"), F.count(F.lit(1)).alias("review_count"))
    )
    active = warehouses.filter(F.col("is_active") == F.lit(True)).select("warehouse_id")
    stock = (
        inventory.join(active, "warehouse_id", "left_semi")
        .groupBy("product_id")
        .agg(
            F.sum(F.when(F.col("inventory_level") <= F.col("reorder_point"), 1).otherwise(0))
            .cast("long")
            .alias("low_stock_warehouses")
        )
    )
    joined = (
        sales.join(rated, "product_id", "left")
        .join(stock, "product_id", "left")
        .withColumn("review_count", F.coalesce(F.col("review_count"), F.lit(0)))
    )
    kept = [c for c in joined.columns if c not in ranks]
    return joined.select(*kept, *ranks)


# --------------------------------------------------------------------- J19
def time_based_sales(oid: DataFrame) -> DataFrame:
    """Per (month, category): sales, then per category over its months (by
    row, so a missing month is skipped): previous revenue, growth %, mean of
    the last three rows, running total. The windows run over the aggregated
    table - one row per category and month."""
    lines = oid.withColumn("month", F.trunc("order_date", "MM"))
    keys = ["month", "category_id", "category_name"]
    monthly = lines.groupBy(*keys).agg(
        F.sum("net_item_amount").cast(MONEY4).alias("monthly_revenue"),
        F.sum("quantity").cast("long").alias("monthly_units_sold"),
        F.sum("item_profit").cast(MONEY4).alias("monthly_profit"),
    )
    monthly = with_distinct_counts(
        monthly, lines, keys, {"monthly_order_count": "order_id", "monthly_customer_count": "order_customer_id"}
    ).select(
        *keys, "monthly_revenue", "monthly_order_count", "monthly_customer_count", "monthly_units_sold",
        "monthly_profit",
    )
    w = Window.partitionBy("category_id").orderBy("month")
    rev = F.col("monthly_revenue")
    prev = F.lag(rev).over(w)
    last3 = w.rowsBetween(-2, Window.currentRow)
    return monthly.select(
        "*",
        prev.alias("prev_month_revenue"),
        F.when(
            prev.isNotNull(), (rev - prev).cast("double") / F.nullif(prev.cast("double"), F.lit(0.0)) * 100
        ).alias("month_over_month_growth"),
        (F.sum(rev).over(last3).cast("double") / F.count(rev).over(last3)).alias("three_month_moving_avg"),
        F.sum(rev).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast(MONEY4).alias(
            "cumulative_revenue"
        ),
    )


# --------------------------------------------------------------------- J20
def top_names_by_revenue(lines: DataFrame, names: dict[str, str]) -> DataFrame:
    """Per (country, city) and each entry of ``names`` (output -> column), the
    name with the most net revenue (ties: lowest); a name without a known
    revenue comes last. One pass over the lines for all names."""
    kinds = F.array(*[F.struct(F.lit(out).alias("kind"), F.col(c).alias("name")) for out, c in names.items()])
    per_name = (
        lines.select("country", "city", "net_item_amount", F.explode(kinds).alias("__n"))
        .groupBy("country", "city", "__n.kind", "__n.name")
        .agg(F.sum("net_item_amount").alias("__rev"))
    )
    rev = F.col("__rev")
    best = F.struct(rev.isNull().alias("unknown"), (-rev).alias("r"), F.col("name").alias("n"))
    return per_name.groupBy("country", "city").agg(
        *[F.min(F.when(F.col("kind") == out, best))["n"].alias(out) for out in names]
    )


def geographic_sales(cb: DataFrame, oh: DataFrame, oid: DataFrame) -> DataFrame:
    """Per (country, city) of the customer base: orders, customers, money,
    shipping, delays, and the top category and brand by net revenue. Top
    values are matched on equal country and city, so a NULL city gets none."""
    geo = cb.select("customer_id", "country", "city")
    orders_geo = geo.join(oh, "customer_id")
    delay = F.col("delivery_delay_days")
    keys = ["country", "city"]
    totals = orders_geo.groupBy(*keys).agg(
        F.sum("final_amount").cast(MONEY2).alias("total_revenue"),
        _avg(F.col("final_amount")).alias("average_order_value"),
        F.sum("shipping_cost").cast(MONEY2).alias("total_shipping_cost"),
        _avg(F.col("shipping_cost")).alias("average_shipping_cost"),
        F.sum(F.when(delay > 0, 1).otherwise(0)).cast("long").alias("delayed_deliveries"),
        _avg(F.when(delay > 0, delay)).alias("average_delay_days"),
    )
    totals = with_distinct_counts(
        totals, orders_geo, keys, {"total_orders": "order_id", "total_customers": "customer_id"}
    ).select(
        *keys, "total_orders", "total_customers", "total_revenue", "average_order_value", "total_shipping_cost",
        "average_shipping_cost", "delayed_deliveries", "average_delay_days",
    )
    lines = oid.select(
        F.col("order_customer_id").alias("customer_id"), "category_name", "brand_name", "net_item_amount"
    ).join(geo.filter(F.col("country").isNotNull() & F.col("city").isNotNull()), "customer_id")
    tops = top_names_by_revenue(lines, {"top_category": "category_name", "top_brand": "brand_name"})
    # Plain equality on (country, city): a NULL city never matches.
    return totals.join(tops, keys, "left")


# --------------------------------------------------------------------- J21
def customer_rfm(
    cop: DataFrame, reviews: DataFrame, tickets: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """RFM string and label from J17's recency label and tiles, the carried
    customer metrics, and review / support-ticket figures in the window.
    (The original text ends inside this query; its last column is named
    ``average_satisfaction_score`` here.)"""
    rev = (
        reviews.filter(_in_window("review_date", start, end))
        .groupBy("customer_id")
        .agg(_avg(F.col("review_rating")).alias("average_review_rating"), F.count(F.lit(1)).alias("review_count"))
    )
    tix = (
        tickets.filter(_in_window("created_date", start, end))
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("support_ticket_count"),
            _avg(F.col("satisfaction_score")).alias("average_satisfaction_score"),
        )
    )
    r, f, m = F.col("recency_segment"), F.col("frequency_segment"), F.col("monetary_segment")
    return (
        cop.join(rev, "customer_id", "left")
        .join(tix, "customer_id", "left")
        .select(
            "customer_id",
            "recency_segment",
            "frequency_segment",
            "monetary_segment",
            F.concat(r, F.lit("-"), f.cast("string"), F.lit("-"), m.cast("string")).alias("rfm_segment"),
            rules.tile_segment(r, m, f).alias("customer_segment"),
            "total_orders",
            "total_spent",
            "average_order_value",
            "first_purchase_date",
            "last_purchase_date",
            "customer_lifespan_days",
            "average_days_between_orders",
            "cancelled_orders",
            "returned_orders",
            "unique_products_purchased",
            "unique_categories_purchased",
            "average_review_rating",
            F.coalesce(F.col("review_count"), F.lit(0)).alias("review_count"),
            F.coalesce(F.col("support_ticket_count"), F.lit(0)).alias("support_ticket_count"),
            "average_satisfaction_score",
        )
    )
