"""Customer-360 jobs over a transactions table (the first e-commerce model).

Every job is a function from DataFrames (and explicit parameters) to a
DataFrame. Grain of the inputs:

* ``tx``   - cleaned transactions, one row per transaction line (J3);
* ``meta`` - one row per user (J4);
* ``pm``   - one row per (product_id, product_category) (J6).

Money stays DECIMAL while it is summed, so totals are exact; averages are
``sum / count`` in DOUBLE. Aggregates over DOUBLE inputs (averages of
averages, medians) are reported to 6 decimals because their last bits depend
on the order of summation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators.distinct import distinct_counts_of, with_distinct_counts
from tessera.operators.pages import PAGE_SIZE, paged_arrays, unnest
from tessera.operators.selection import percentile_cont
from tessera.operators.slices import lead_by_slices, position_by_slices
from tessera.operators.topvalue import top_values

MONEY = "decimal(38,4)"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Order of a user's purchases. (time, transaction, product) leaves only
# duplicate order lines tied; the line amount orders those, and lines equal
# on all four carry equal values.
PURCHASE_ORDER = ("transaction_time", "transaction_id", "product_id", "total_price")


def _date(d: dt.date | str) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d))


def _avg(col: Column) -> Column:
    """AVG as exact sum over count, in DOUBLE (NULLs ignored)."""
    return F.sum(col).cast("double") / F.count(col)


def _ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / den.cast("double")


def _join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two per-group results on their group key, NULL matching NULL
    (a NULL key is a group of its own, as in GROUP BY)."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


# --------------------------------------------------------------------- J3
def clean_transactions(transactions: DataFrame, start: dt.date, end_exclusive: dt.date) -> DataFrame:
    """Parse times, price lines, bucket devices, drop test rows, keep the window.

    The window is half-open on the parsed time. Because the raw text has a
    fixed ``yyyy-MM-dd HH:mm:ss`` layout, the same bounds compared as text
    select the same rows; that text predicate can reach the parquet scan.
    """
    raw_time = F.col("transaction_time")
    ts = F.to_timestamp_ntz(raw_time, F.lit(TIME_FORMAT))
    start_ts = F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz")
    end_ts = F.lit(dt.datetime.combine(end_exclusive, dt.time())).cast("timestamp_ntz")
    return (
        transactions.filter(
            (raw_time >= F.lit(start.isoformat()))
            & (raw_time < F.lit(end_exclusive.isoformat()))
            & (F.col("is_test_transaction") == F.lit(False))
        )
        .select(
            "transaction_id",
            "user_id",
            ts.alias("transaction_time"),
            "product_id",
            "product_category",
            "quantity",
            "unit_price",
            (F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("total_price"),
            "payment_method",
            "shipping_country",
            rules.device_bucket(F.col("device_type")).alias("device_type_clean"),
            "is_return",
        )
        .filter((F.col("transaction_time") >= start_ts) & (F.col("transaction_time") < end_ts))
    )


def _sale(value: Column | str, other=0) -> Column:
    """CASE WHEN is_return THEN other ELSE value END (NULL flag counts as a sale)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("is_return"), F.lit(other)).otherwise(v)


def _returned(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("is_return"), v).otherwise(F.lit(0))


# --------------------------------------------------------------------- J4
MODES = {
    "most_used_payment_method": "payment_method",
    "most_common_shipping_country": "shipping_country",
    "most_common_device_type": "device_type_clean",
}


def customer_metadata(tx: DataFrame) -> DataFrame:
    """Per user: first/last purchase, distinct counts, spend, returns, modes."""
    totals = tx.groupBy("user_id").agg(
        F.min("transaction_time").alias("first_purchase_date"),
        F.max("transaction_time").alias("last_purchase_date"),
        F.sum(_sale("total_price")).cast(MONEY).alias("total_spend"),
        F.sum(_sale(F.lit(1))).cast("long").alias("total_purchases"),
        F.sum(_returned("quantity")).cast("long").alias("total_items_returned"),
    )
    # modes and distinct counts from one pass over (user, argument, value) counts
    values = top_values(tx, ["user_id"], MODES, distinct={
        "total_transactions": "transaction_id",
        "distinct_categories_purchased": "product_category",
        "distinct_purchase_days": F.to_date("transaction_time"),
    })
    return _join_groups(totals, values, ["user_id"], "left").select(
        "user_id", "first_purchase_date", "last_purchase_date", "total_transactions", "total_spend",
        "total_purchases", "total_items_returned", "distinct_categories_purchased", "distinct_purchase_days",
        *MODES,
    )


# Values that a top-count sketch tracks; see ``mode_error``.
TRACKED = 10_000


def mode_sketches(tx: DataFrame, by: Sequence[str] = ("user_id",), tracked: int = TRACKED) -> DataFrame:
    """J4b, storable: per group of ``by`` one bounded top-count sketch per mode
    column and the number of rows ``n`` that it saw, in one aggregation.
    Sketches of parts of a group (of each month, say) can be kept and merged."""
    made = [F.expr(f"approx_top_k_accumulate({c}, {int(tracked)})").alias(name) for name, c in MODES.items()]
    return tx.groupBy(*by).agg(*made, F.count(F.lit(1)).alias("n"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ("user_id",), tracked: int = TRACKED) -> DataFrame:
    """Sketches of the groups of ``by`` from stored sketches of finer groups."""
    merged = [F.expr(f"approx_top_k_combine({name}, {int(tracked)})").alias(name) for name in MODES]
    return sketches.groupBy(*by).agg(*merged, F.sum("n").alias("n"))


def mode_error(n: Column, tracked: int = TRACKED) -> Column:
    """Bound of a sketch's error: the counts of ``n`` rows are off by at most
    3.5 n / (size of its table: the power of two at or above tracked / 0.75).
    They are exact as long as a group has at most ``tracked`` values."""
    table = 1
    while table * 0.75 < tracked:
        table *= 2
    return F.lit(3.5) * n / table


def modes_of(sketches: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """The modes and how often each occurs (``<mode>_count``), as estimated."""
    top = {name: F.expr(f"approx_top_k_estimate({name}, 1)")[0] for name in MODES}
    return sketches.select(
        *by,
        *[t["item"].alias(name) for name, t in top.items()],
        *[t["count"].alias(f"{name}_count") for name, t in top.items()],
        "n",
    )


def customer_modes_approx(tx: DataFrame) -> DataFrame:
    """J4b: the three modes of a user by sketches, in one aggregation. Of tied
    values any may be chosen; the count is the same."""
    return modes_of(mode_sketches(tx)).drop("n")


# --------------------------------------------------------------------- J5
def _days_since(as_of: dt.date, ts: str) -> Column:
    return F.datediff(_date(as_of), F.to_date(ts))


def _rfm_columns(as_of: dt.date) -> list[Column]:
    """Recency / frequency / monetary values and scores, each computed once."""
    days = _days_since(as_of, "last_purchase_date")
    r = rules.recency_score(days)
    f = rules.frequency_score(F.col("total_transactions"))
    m = rules.monetary_score(F.col("total_spend"))
    return [
        days.alias("recency_days"),
        F.col("total_transactions").alias("frequency"),
        F.col("total_spend").alias("monetary"),
        r.alias("recency_score"),
        f.alias("frequency_score"),
        m.alias("monetary_score"),
        (r + f + m).alias("rfm_total_score"),
    ]


def rfm_scores(meta: DataFrame, as_of: dt.date) -> DataFrame:
    return meta.select("user_id", *_rfm_columns(as_of))


def customer_segments(meta: DataFrame, as_of: dt.date) -> DataFrame:
    """RFM scores, all metadata columns and the segment label in one pass
    (no join of the scores back to their own input)."""
    carried = [c for c in meta.columns if c != "user_id"]
    return meta.select("user_id", *_rfm_columns(as_of), *carried).withColumn(
        "customer_segment",
        rules.rfm_segment(
            F.col("rfm_total_score"), F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
        ),
    )


# --------------------------------------------------------------------- J6
def _with_customer_counts(groups: DataFrame, tx: DataFrame, keys: list[str], customers: str, transactions: str):
    """``groups`` plus distinct customers (all, on mobile, on desktop) and
    distinct transactions of each group: one reduction to distinct
    (group, user) with device flags, one to distinct (group, transaction)."""
    device = F.col("device_type_clean")
    users = distinct_counts_of(
        tx, keys, "user_id",
        {customers: None, "mobile_customers": device == "mobile", "desktop_customers": device == "desktop"},
    )
    txs = distinct_counts_of(tx, keys, "transaction_id", {transactions: None})
    joined = _join_groups(_join_groups(groups, users, keys, "left"), txs, keys, "left")
    counted = [customers, "mobile_customers", "desktop_customers", transactions]
    return joined.select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in counted else F.col(c) for c in joined.columns]
    )


def product_metrics(tx: DataFrame) -> DataFrame:
    keys = ["product_id", "product_category"]
    returned_qty = F.sum(_returned("quantity"))
    sums = tx.groupBy(*keys).agg(
        F.sum("quantity").cast("long").alias("total_quantity_sold"),
        F.sum("total_price").cast(MONEY).alias("total_revenue"),
        returned_qty.cast("long").alias("total_quantity_returned"),
        F.sum(_returned("total_price")).cast(MONEY).alias("total_revenue_returned"),
        _avg(F.col("quantity")).alias("avg_quantity_per_transaction"),
        _avg(F.col("total_price")).alias("avg_revenue_per_transaction"),
        _ratio(returned_qty, F.sum("quantity")).alias("return_rate"),
    )
    counts = _with_customer_counts(sums, tx, keys, "unique_customers", "transaction_count")
    return counts.select(
        *keys, "unique_customers", "total_quantity_sold", "total_revenue", "total_quantity_returned",
        "total_revenue_returned", "transaction_count", "avg_quantity_per_transaction",
        "avg_revenue_per_transaction", "return_rate", "mobile_customers", "desktop_customers",
    )


# --------------------------------------------------------------------- J7
def category_metrics(pm: DataFrame) -> DataFrame:
    """Roll-up of product metrics per category, with the median of the
    products' revenue per transaction inside each category.

    ``category_unique_customers`` sums per-product distinct customers, so a
    customer is counted once per product bought (as in the reference).
    """
    sums = pm.groupBy("product_category").agg(
        F.countDistinct("product_id").alias("unique_products"),
        F.sum("total_quantity_sold").cast("long").alias("category_quantity_sold"),
        F.sum("total_revenue").cast(MONEY).alias("category_revenue"),
        F.sum("total_quantity_returned").cast("long").alias("category_quantity_returned"),
        F.sum("total_revenue_returned").cast(MONEY).alias("category_revenue_returned"),
        F.sum("unique_customers").cast("long").alias("category_unique_customers"),
        F.sum("transaction_count").cast("long").alias("category_transaction_count"),
        rules.round_half_up(F.avg("avg_quantity_per_transaction"), 6).alias("category_avg_quantity"),
        rules.round_half_up(F.avg("avg_revenue_per_transaction"), 6).alias("category_avg_revenue"),
        _ratio(F.sum("total_quantity_returned"), F.sum("total_quantity_sold")).alias("category_return_rate"),
    )
    medians = percentile_cont(
        pm, ["product_category"], "avg_revenue_per_transaction", 0.5, "median_revenue_per_transaction"
    ).withColumn("median_revenue_per_transaction", rules.round_half_up(F.col("median_revenue_per_transaction"), 6))
    return sums.join(medians, "product_category", "left")


def product_global_median(pm: DataFrame) -> DataFrame:
    """J7b: every product row plus the median over all products (``OVER ()``).

    The median is one value found by selection and attached as a scalar
    subquery - not a window over a single partition."""
    median = percentile_cont(pm, [], "avg_revenue_per_transaction", 0.5, "m")
    return pm.withColumn("median_revenue_per_transaction", rules.round_half_up(median.scalar(), 6))


# --------------------------------------------------------------------- J8
def time_analysis(tx: DataFrame) -> DataFrame:
    day = tx.withColumn("transaction_date", F.to_date("transaction_time"))
    keys = ["transaction_date"]
    daily = day.groupBy(*keys).agg(
        F.weekofyear("transaction_date").alias("week_of_year"),
        F.month("transaction_date").alias("month_of_year"),
        F.quarter("transaction_date").alias("quarter_of_year"),
        F.sum("total_price").cast(MONEY).alias("daily_revenue"),
        F.sum(_sale("total_price")).cast(MONEY).alias("daily_net_revenue"),
        F.sum(_returned("total_price")).cast(MONEY).alias("daily_returns"),
        F.sum(_sale("quantity")).cast("long").alias("daily_quantity_sold"),
        _avg(_sale("total_price")).alias("avg_order_value"),
    )
    counts = _with_customer_counts(daily, day, keys, "daily_customers", "daily_transactions")
    tops = top_values(day, keys, {"top_category": "product_category", "top_payment_method": "payment_method"})
    return _join_groups(counts, tops, keys, "left")


# --------------------------------------------------------------------- J9
def _purchase_day() -> Column:
    """Where a user's purchases can be cut: days since 1970."""
    return F.unix_date(F.to_date("transaction_time"))


def purchase_history(tx: DataFrame) -> DataFrame:
    """J9a, history part: every purchase line of a user (returns included),
    one row per array element with its 1-based ``position``.

    Long form instead of one array per user: a user's history is unbounded,
    and a row per element keeps the work spread over tasks."""
    lines = tx.select("user_id", "transaction_time", "transaction_id", "product_id", "product_category", "total_price")
    return position_by_slices(lines, ["user_id"], PURCHASE_ORDER, _purchase_day(), "position")


def purchase_sequence(tx: DataFrame) -> DataFrame:
    """J9a, sequence part: non-return purchases with the next purchase of the
    same user. Rows whose return flag is NULL are left out (``NOT is_return``)."""
    sales = tx.filter(~F.col("is_return")).select(
        "user_id", "transaction_time", "transaction_id", "product_id", "product_category", "total_price"
    )
    seq = lead_by_slices(
        sales,
        ["user_id"],
        PURCHASE_ORDER,
        _purchase_day(),
        {"next_category": "product_category", "next_purchase_time": "transaction_time"},
        position="step",
    )
    return seq.select(
        "user_id",
        "step",
        F.col("next_category"),
        F.col("product_category").alias("current_category"),
        F.col("next_purchase_time"),
        F.col("transaction_time").alias("current_purchase_time"),
        F.datediff(F.to_date("next_purchase_time"), F.to_date("transaction_time")).alias("days_to_next_purchase"),
    )


HISTORY_FIELDS = ("transaction_time", "transaction_id", "product_id", "product_category", "total_price")


def purchase_pages(tx: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """J9a as ordered arrays: a user's purchases (returns included) as pages of
    at most ``page_size`` elements, each page one array of structs."""
    return paged_arrays(tx, ["user_id"], PURCHASE_ORDER, _purchase_day(), HISTORY_FIELDS, page_size)


def page_columns(pages: DataFrame) -> DataFrame:
    """``purchase_pages`` with one array per field, in plain types."""
    field = lambda f: F.col(f"items.{f}")
    return pages.select(
        "user_id",
        "page",
        "first_position",
        F.size("items").alias("n_items"),
        F.transform(field("transaction_time"), lambda t: F.date_format(t, TIME_FORMAT)).alias("transaction_times"),
        field("transaction_id").alias("transaction_ids"),
        field("product_id").alias("product_ids"),
        field("product_category").alias("product_categories"),
        field("total_price").cast("array<double>").alias("total_prices"),
    )


def sequence_from_pages(tx: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """``purchase_sequence`` by way of arrays: the pages of the non-return
    purchases, read as a relation with each element's successor."""
    pages = purchase_pages(tx.filter(~F.col("is_return")), page_size)
    steps = unnest(
        pages,
        ["user_id"],
        {"step": "position", "current_category": "product_category", "current_purchase_time": "transaction_time"},
        {"next_category": "product_category", "next_purchase_time": "transaction_time"},
    )
    return steps.select(
        "user_id",
        "step",
        "next_category",
        "current_category",
        "next_purchase_time",
        "current_purchase_time",
        F.datediff(F.to_date("next_purchase_time"), F.to_date("current_purchase_time")).alias("days_to_next_purchase"),
    )


def purchase_patterns(seq: DataFrame, meta: DataFrame) -> DataFrame:
    """J9b: per user, mean calendar days between consecutive purchases and the
    most common next category (ties: lowest name). Users with no sequence -
    only returns - keep NULLs."""
    gaps = seq.groupBy("user_id").agg(_avg(F.col("days_to_next_purchase")).alias("avg_days_between_purchases"))
    nexts = top_values(seq, ["user_id"], {"most_common_next_category": "next_category"}, count_nulls=False)
    return meta.select("user_id").join(gaps, "user_id", "left").join(nexts, "user_id", "left")


# --------------------------------------------------------------------- J10
def _month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def monthly_cohorts(tx: DataFrame, meta: DataFrame) -> DataFrame:
    """Per (first-purchase month, months since): cohort size (all users of the
    month), users with a non-return purchase in that month offset, their spend
    and orders, and per-user rates."""
    cohorts = meta.select("user_id", F.trunc(F.to_date("first_purchase_date"), "MM").alias("cohort_month"))
    sizes = cohorts.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    activity = (
        tx.filter(~F.col("is_return"))
        .select("user_id", "transaction_id", "total_price", "transaction_time")
        .join(cohorts, "user_id")
        .withColumn(
            "months_since_cohort",
            (_month_index(F.to_date("transaction_time")) - _month_index(F.col("cohort_month"))).cast("int"),
        )
    )
    groups = (
        activity.groupBy("cohort_month", "months_since_cohort")
        .agg(
            F.sum("total_price").cast(MONEY).alias("total_spend"),
        )
    )
    month = ["cohort_month", "months_since_cohort"]
    groups = with_distinct_counts(
        groups, activity, month, {"retained_users": "user_id", "total_orders": "transaction_id"}
    ).filter(F.col("months_since_cohort") >= 0)
    size = F.col("cohort_size")
    return groups.join(sizes, "cohort_month").select(
        "cohort_month",
        "cohort_size",
        "months_since_cohort",
        "retained_users",
        rules.round_half_up(F.col("retained_users") / size * 100, 2).alias("retention_rate"),
        "total_spend",
        # money: exact decimal division, rounded half up
        F.round(F.col("total_spend") / size, 2).cast("decimal(38,2)").alias("avg_spend_per_user"),
        "total_orders",
        rules.round_half_up(F.col("total_orders") / size, 2).alias("avg_orders_per_user"),
    )


# --------------------------------------------------------------------- J11
def latest_category(tx: DataFrame) -> DataFrame:
    """Category of each user's latest purchase line (time, transaction, product)."""
    latest = F.max(F.struct(*[F.col(c) for c in PURCHASE_ORDER], F.col("product_category")))
    return tx.groupBy("user_id").agg(latest["product_category"].alias("latest_category"))


def predictive_metrics(segments: DataFrame, patterns: DataFrame, tx: DataFrame, as_of: dt.date) -> DataFrame:
    days = _days_since(as_of, "last_purchase_date")
    one_tx = F.col("total_transactions") == 1
    gap = F.coalesce(F.col("avg_days_between_purchases"), F.when(one_tx, F.lit(90.0)).otherwise(F.lit(30.0)))
    factor = rules.first_match(
        [(F.col("customer_segment") == seg, F.lit(Decimal(f))) for seg, f in rules.LIFETIME_FACTOR],
        F.lit(Decimal(rules.LIFETIME_FACTOR_DEFAULT)),
    )
    base = segments.select(
        "user_id", "customer_segment", "last_purchase_date", "total_spend", "total_transactions"
    )
    return (
        base.join(patterns, "user_id", "left")
        .join(latest_category(tx), "user_id", "left")
        .select(
            "user_id",
            "customer_segment",
            "last_purchase_date",
            "total_spend",
            "total_transactions",
            rules.tier(days, rules.CHURN_RISK, rules.CHURN_RISK_DEFAULT, op=">").alias("churn_risk"),
            F.date_add(F.to_date("last_purchase_date"), F.round(gap).cast("int")).alias(
                "predicted_next_purchase_date"
            ),
            F.coalesce(F.col("most_common_next_category"), F.when(one_tx, F.col("latest_category"))).alias(
                "predicted_next_category"
            ),
            (F.col("total_spend") * factor).cast("decimal(38,5)").alias("projected_lifetime_value"),
        )
    )


# --------------------------------------------------------------------- J12
def user_products(tx: DataFrame, pm: DataFrame) -> DataFrame:
    """Per user, the metrics of each distinct product bought (long form)."""
    bought = tx.select("user_id", "product_id", "product_category").distinct()
    return bought.join(
        pm.select("product_id", "product_category", "total_quantity_sold", "total_revenue"),
        ["product_id", "product_category"],
    ).select("user_id", "product_id", "product_category", "total_quantity_sold", "total_revenue")


def user_product_pages(tx: DataFrame, pm: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """J12 as arrays: a user's products by id, as pages. Ids are cut in
    thousands, which never decrease along them."""
    products = user_products(tx, pm)
    fields = ("product_id", "product_category", "total_quantity_sold", "total_revenue")
    pages = paged_arrays(
        products, ["user_id"], fields[:2], F.floor(F.col("product_id") / 1000), fields, page_size
    )
    return pages.select(
        "user_id",
        "page",
        "first_position",
        F.col("items.product_id").alias("product_ids"),
        F.col("items.product_category").alias("product_categories"),
        F.col("items.total_quantity_sold").alias("quantities_sold"),
        F.col("items.total_revenue").cast("array<double>").alias("revenues"),
    )


# --------------------------------------------------------------------- J13
def primary_products(tx: DataFrame) -> DataFrame:
    """Each user's product with the most non-return spend (then lowest id); a
    product without a known spend comes last."""
    per_product = tx.groupBy("user_id", "product_id", "product_category").agg(
        F.sum(_sale("total_price")).alias("net")
    )
    net = F.col("net")
    best = F.min(F.struct(net.isNull().alias("unknown"), (-net).alias("n"), F.col("product_id"), F.col("product_category")))
    return per_product.groupBy("user_id").agg(best.alias("b")).select(
        "user_id", F.col("b.product_id").alias("product_id"), F.col("b.product_category").alias("product_category")
    )


REPORT_ORDER = (F.desc, "total_spend"), (F.desc, "total_transactions"), (F.asc, "user_id")


def _report_order() -> list[Column]:
    return [direction(c) for direction, c in REPORT_ORDER]


def top_by_spend(users: DataFrame, k: int, accuracy: int = 10000) -> DataFrame:
    """The ``k`` first users of the report, before its joins: every sort key
    is in the one-row-per-user table, and each later join adds at most one row
    per user.

    Sorting takes the top ``k`` rows of every partition to one task, so rows
    that cannot be among them go first. ``t`` is the quantile that ``k`` rows
    reach, lowered by twice the sketch's rank error (at most ``1 / accuracy``
    of the rows), so at least ``k`` rows reach ``t``, or all do."""
    n = users.agg(F.count("total_spend")).first()[0]
    q = max(0.0, 1.0 - k / max(n, 1) - 2.0 / accuracy)
    t = users.agg(F.percentile_approx("total_spend", q, accuracy).alias("t"))
    low = F.col("total_spend") < t.scalar()
    reach = users.filter(~F.coalesce(low, F.lit(False)))  # users without a known spend sort last
    return reach.orderBy(*_report_order()).limit(k)


def customer_360(
    segments: DataFrame,
    pm: DataFrame,
    cm: DataFrame,
    patterns: DataFrame,
    cohorts: DataFrame,
    predictive: DataFrame,
    primary: DataFrame,
    as_of: dt.date,
    limit: int | None = 10000,
) -> DataFrame:
    """One wide row per user, top ``limit`` by spend then transactions then id.

    Product columns come from the user's primary product, category columns
    from that product's category, cohort columns from the row of the user's
    first-purchase month at the offset of the last purchase."""
    products = pm.select(
        "product_id",
        "product_category",
        F.col("unique_customers").alias("products_unique_customers"),
        F.col("total_quantity_sold").alias("products_total_quantity_sold"),
        F.col("total_revenue").alias("products_total_revenue"),
        F.col("total_quantity_returned").alias("products_total_quantity_returned"),
        F.col("total_revenue_returned").alias("products_total_revenue_returned"),
        F.col("transaction_count").alias("products_transaction_count"),
        F.col("avg_quantity_per_transaction").alias("products_avg_quantity"),
        F.col("avg_revenue_per_transaction").alias("products_avg_revenue"),
        F.col("return_rate").alias("products_return_rate"),
    )
    categories = cm.select(
        "product_category",
        F.col("unique_products").alias("category_unique_products"),
        *[c for c in cm.columns if c not in ("product_category", "unique_products")],
    )
    cohort_cols = cohorts.select(
        "cohort_month",
        "months_since_cohort",
        "cohort_size",
        "retained_users",
        "retention_rate",
        F.col("total_spend").alias("cohort_total_spend"),
        "avg_spend_per_user",
        F.col("total_orders").alias("cohort_total_orders"),
        "avg_orders_per_user",
    )
    if limit:
        segments = top_by_spend(segments, limit)
    first_day, last_day = F.to_date("first_purchase_date"), F.to_date("last_purchase_date")
    users = segments.withColumn("cohort_month", F.trunc(first_day, "MM")).withColumn(
        "months_since_cohort", (_month_index(last_day) - _month_index(F.col("cohort_month"))).cast("int")
    )
    spend = F.col("total_spend").cast("double")
    span = F.datediff(last_day, first_day)
    wide = (
        users.join(primary, "user_id", "left")
        .join(patterns.select("user_id", "avg_days_between_purchases", "most_common_next_category"), "user_id", "left")
        .join(
            predictive.select(
                "user_id", "churn_risk", "predicted_next_purchase_date", "predicted_next_category",
                "projected_lifetime_value",
            ),
            "user_id",
            "left",
        )
        .join(products, ["product_id", "product_category"], "left")
        .join(categories, "product_category", "left")
        .join(cohort_cols, ["cohort_month", "months_since_cohort"], "left")
    )
    has_cohort_row = F.col("cohort_size").isNotNull()
    out = wide.select(
        "user_id", "first_purchase_date", "last_purchase_date", "total_transactions", "total_spend",
        "total_purchases", "total_items_returned", "distinct_categories_purchased", "distinct_purchase_days",
        "most_used_payment_method", "most_common_shipping_country", "most_common_device_type",
        "customer_segment", "recency_days", "frequency", "monetary", "recency_score", "frequency_score",
        "monetary_score", "rfm_total_score",
        "products_unique_customers", "products_total_quantity_sold", "products_total_revenue",
        "products_total_quantity_returned", "products_total_revenue_returned", "products_transaction_count",
        "products_avg_quantity", "products_avg_revenue", "products_return_rate",
        "category_unique_products", "category_quantity_sold", "category_revenue", "category_quantity_returned",
        "category_revenue_returned", "category_unique_customers", "category_transaction_count",
        "category_avg_quantity", "category_avg_revenue", "category_return_rate", "median_revenue_per_transaction",
        "avg_days_between_purchases", "most_common_next_category",
        F.when(has_cohort_row, F.col("cohort_month")).alias("cohort_month"),
        "cohort_size",
        F.when(has_cohort_row, F.col("months_since_cohort")).alias("months_since_cohort"),
        "retained_users", "retention_rate", "cohort_total_spend", "avg_spend_per_user", "cohort_total_orders",
        "avg_orders_per_user",
        "churn_risk", "predicted_next_purchase_date", "predicted_next_category", "projected_lifetime_value",
        F.try_divide(spend, F.col("total_transactions")).alias("avg_spend_per_transaction"),
        F.try_divide(spend, F.col("distinct_purchase_days")).alias("avg_spend_per_day"),
        F.try_divide(F.col("total_items_returned").cast("double"), F.col("total_purchases")).alias("return_rate"),
        _days_since(as_of, "first_purchase_date").alias("days_since_first_purchase"),
        F.when(span == 0, F.lit(0.0)).otherwise(F.try_divide(spend, span) * 30).alias("monthly_spend_rate"),
        rules.season(F.month("last_purchase_date")).alias("last_purchase_season"),
        rules.tier(F.col("total_spend"), rules.VALUE_TIER, rules.VALUE_TIER_DEFAULT).alias("value_tier"),
        rules.category_behavior(F.col("distinct_categories_purchased")).alias("category_behavior"),
    )
    return out.orderBy(*_report_order())
