"""Hand-made edge cases the test tables do not reach (FIXTURES.md section 3)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from tessera.plans import commerce, orders, region

from .conftest import rows

D = dt.date
TX_SCHEMA = (
    "transaction_id long, user_id long, transaction_time string, product_id long, product_category string, "
    "quantity long, unit_price decimal(18,4), payment_method string, shipping_country string, "
    "device_type string, is_return boolean, is_test_transaction boolean"
)
START, END = D(2023, 1, 1), D(2024, 1, 1)
AS_OF = D(2024, 1, 1)


def tx_row(tid, uid, time, pid=1, cat="A", qty=1, price="10", pay="card", country="X", device="mobile",
           ret=False, test=False):
    return (tid, uid, time, pid, cat, qty, Decimal(price), pay, country, device, ret, test)


def clean(spark, data):
    return commerce.clean_transactions(spark.createDataFrame(data, TX_SCHEMA), START, END)


def test_window_is_half_open_and_test_rows_are_dropped(spark):
    tx = clean(spark, [
        tx_row(1, 1, "2023-01-01 00:00:00"),
        tx_row(2, 1, "2023-12-31 23:59:59"),
        tx_row(3, 1, "2024-01-01 00:00:00"),
        tx_row(4, 1, "2022-12-31 23:59:59"),
        tx_row(5, 1, "2023-06-01 00:00:00", test=True),
    ])
    assert [r[0] for r in rows(tx, "transaction_id")] == [1, 2]


def test_bad_time_text_is_an_error(spark):
    tx = clean(spark, [tx_row(1, 1, "2023-13-45 00:00:00")])
    with pytest.raises(Exception, match="CANNOT_PARSE|parse|Invalid"):
        tx.collect()


def test_null_return_flag_counts_as_sale_but_not_in_sequence(spark):
    tx = clean(spark, [
        tx_row(1, 1, "2023-01-01 10:00:00", price="5", ret=None),
        tx_row(2, 1, "2023-01-02 10:00:00", price="7"),
    ])
    meta = commerce.customer_metadata(tx)
    r = meta.first()
    assert r["total_spend"] == Decimal("12.0000") and r["total_purchases"] == 2
    seq = commerce.purchase_sequence(tx)
    assert rows(seq, "current_purchase_time") == [(dt.datetime(2023, 1, 2, 10),)]


def test_returns_only_user_keeps_nulls(spark):
    tx = clean(spark, [
        tx_row(1, 1, "2023-03-01 10:00:00", ret=True),
        tx_row(2, 2, "2023-03-01 10:00:00"),
        tx_row(3, 2, "2023-03-05 10:00:00", cat="B"),
    ])
    meta = commerce.customer_metadata(tx)
    pat = commerce.purchase_patterns(commerce.purchase_sequence(tx), meta)
    assert rows(pat) == [(1, None, None), (2, 4.0, "B")]


def test_modes_tie_to_lowest_and_count_null(spark):
    tx = clean(spark, [
        tx_row(1, 1, "2023-03-01 10:00:00", pay="b", country=None),
        tx_row(2, 1, "2023-03-02 10:00:00", pay="a", country=None),
        tx_row(3, 1, "2023-03-03 10:00:00", pay=None, country="Z"),
    ])
    r = commerce.customer_metadata(tx).first()
    assert r["most_used_payment_method"] == "a"  # a, b, NULL once each: lowest non-null
    assert r["most_common_shipping_country"] is None  # NULL twice beats Z once


def _predict(spark, data):
    tx = clean(spark, data)
    meta = commerce.customer_metadata(tx)
    seg = commerce.customer_segments(meta, AS_OF)
    pat = commerce.purchase_patterns(commerce.purchase_sequence(tx), meta)
    return {r["user_id"]: r for r in commerce.predictive_metrics(seg, pat, tx, AS_OF).collect()}


def test_one_purchase_predicts_ninety_days_and_latest_category(spark):
    p = _predict(spark, [tx_row(1, 1, "2023-05-01 10:00:00", cat="Q")])[1]
    assert p["predicted_next_purchase_date"] == D(2023, 7, 30)
    assert p["predicted_next_category"] == "Q"


def test_half_day_average_gap_rounds_up(spark):
    p = _predict(spark, [
        tx_row(1, 1, "2023-05-01 10:00:00"),
        tx_row(2, 1, "2023-05-02 10:00:00"),
        tx_row(3, 1, "2023-05-04 10:00:00"),
    ])[1]
    assert p["predicted_next_purchase_date"] == D(2023, 5, 6)  # mean gap 1.5 -> 2


def test_gap_counts_calendar_days(spark):
    tx = clean(spark, [tx_row(1, 1, "2023-05-01 23:00:00"), tx_row(2, 1, "2023-05-02 01:00:00")])
    seq = commerce.purchase_sequence(tx)
    assert sorted((r[0] for r in rows(seq, "days_to_next_purchase")), key=str) == [1, None]


def _c360(spark, data):
    tx = clean(spark, data)
    meta = commerce.customer_metadata(tx)
    seg = commerce.customer_segments(meta, AS_OF)
    pm = commerce.product_metrics(tx)
    pat = commerce.purchase_patterns(commerce.purchase_sequence(tx), meta)
    out = commerce.customer_360(
        seg, pm, commerce.category_metrics(pm), pat, commerce.monthly_cohorts(tx, meta),
        commerce.predictive_metrics(seg, pat, tx, AS_OF), commerce.primary_products(tx), AS_OF,
    )
    return {r["user_id"]: r for r in out.collect()}


def test_customer_360_same_day_rate_and_safe_division(spark):
    out = _c360(spark, [
        tx_row(1, 1, "2023-05-01 10:00:00", price="30"),
        tx_row(2, 1, "2023-05-01 18:00:00", price="20"),
        tx_row(3, 2, "2023-05-01 10:00:00", ret=True),
    ])
    assert out[1]["monthly_spend_rate"] == 0.0
    assert out[2]["return_rate"] is None  # no purchases: SAFE_DIVIDE gives NULL
    assert out[1]["products_unique_customers"] is not None
    assert len(out[1]) == 63


# ------------------------------------------------------------- order model
CUST = ("customer_id long, first_name string, last_name string, email string, registration_date date, "
        "country string, city string, postal_code string")
SUBS = ("customer_id long, subscription_tier string, subscription_start_date date, "
        "subscription_end_date date, monthly_fee decimal(18,2)")


def test_subscriptions_overlap_open_end_and_today(spark):
    cust = spark.createDataFrame([
        (1, "a", "b", "e", D(2023, 12, 2), "X", "c", "p"),  # exactly 30 days before as_of
        (2, "a", "b", "e", D(2020, 1, 1), "X", "c", "p"),
        (3, "a", "b", "e", D(2023, 6, 1), "X", "c", "p"),
    ], CUST)
    subs = spark.createDataFrame([
        (1, "gold", D(2023, 1, 1), None, Decimal("9.00")),  # open end
        (2, "gold", D(2023, 1, 1), D(2024, 1, 1), Decimal("9.00")),  # ends today
        (2, "silver", D(2023, 6, 1), None, Decimal("5.00")),  # overlaps
    ], SUBS)
    out = orders.customer_base(cust, subs, AS_OF)
    got = rows(out, "customer_id", "customer_category", "subscription_tier", "subscription_monthly_fee")
    assert got == [
        (1, "New", "gold", Decimal("9.00")),
        (2, "Loyal", "gold", Decimal("9.00")),
        (2, "Loyal", "silver", Decimal("5.00")),
        (3, "Regular", "None", Decimal("0.00")),
    ]
    latest = orders.customer_base(cust, subs, AS_OF, dedupe_latest=True)
    assert latest.columns == out.columns
    assert rows(latest, "customer_id", "subscription_tier") == [(1, "gold"), (2, "silver"), (3, "None")]


def test_rounding_of_large_doubles(spark):
    from pyspark.sql import functions as F

    from tessera.functions import rules

    df = spark.createDataFrame([(1.2345675,), (-0.5,), (9.5e15,), (1e300,), (None,)], "x double")
    got = [r[0] for r in df.select(rules.round_half_up(F.col("x"), 6)).collect()]
    assert got == [1.234568, -0.5, 9.5e15, 1e300, None]


ORDERS = (
    "order_id long, customer_id long, order_date date, order_timestamp timestamp_ntz, "
    "cart_creation_timestamp timestamp_ntz, total_amount decimal(18,2), discount_amount decimal(18,2), "
    "shipping_cost decimal(18,2), tax_amount decimal(18,2), payment_method string, order_status string, "
    "delivery_address_id long, shipping_method string, estimated_delivery_date date, actual_delivery_date date"
)
SESS = "session_id long, customer_id long, session_timestamp timestamp_ntz"


def order_row(oid, cid, day, amount="100", pay="card", status="Delivered", actual=None):
    ts = dt.datetime.combine(day, dt.time(12))
    return (oid, cid, day, ts, ts - dt.timedelta(minutes=5, seconds=30), Decimal(amount), Decimal("0"),
            Decimal("5"), Decimal("1"), pay, status, cid * 10, "air", day + dt.timedelta(days=7), actual)


def _orders(spark, data):
    return spark.createDataFrame(data, ORDERS)


def test_lookback_bounds_and_repeated_session(spark):
    o = _orders(spark, [order_row(1, 1, D(2023, 6, 1))])
    t = dt.datetime(2023, 6, 1, 12)
    s = spark.createDataFrame([
        (10, 1, t - dt.timedelta(days=30)),  # exactly at the lower bound
        (11, 1, t),  # at the order time
        (12, 1, t - dt.timedelta(days=30, seconds=1)),  # just outside
        (13, 1, t - dt.timedelta(days=2)),
        (13, 1, t - dt.timedelta(days=1)),  # same session twice
        (14, 2, t),  # other customer
    ], SESS)
    oh = orders.order_history(o, s, D(2023, 1, 1), D(2023, 12, 31))
    r = oh.first()
    assert r["sessions_before_purchase"] == 3
    assert r["decision_time_minutes"] == 5


def test_one_order_gap_null_and_all_null_payments(spark):
    o = _orders(spark, [order_row(1, 1, D(2023, 6, 1), pay=None), order_row(2, 2, D(2023, 6, 1)),
                        order_row(3, 2, D(2023, 6, 11)), order_row(4, 3, D(2023, 6, 1))])
    s = spark.createDataFrame([], SESS)
    oh = orders.order_history(o, s, D(2023, 1, 1), D(2023, 12, 31))
    empty_oid = spark.createDataFrame([], "order_id long, product_id long, category_id int, order_customer_id long")
    cop = {r["customer_id"]: r for r in orders.customer_order_patterns(oh, empty_oid, AS_OF, 5).collect()}
    assert cop[1]["average_days_between_orders"] is None
    assert cop[1]["payment_methods_used"] == []
    assert cop[2]["average_days_between_orders"] == 10.0
    assert sorted(r["monetary_segment"] for r in cop.values()) == [1, 2, 3]  # 3 customers, 5 tiles
    assert cop[1]["unique_products_purchased"] == 0


OID = ("order_id long, product_id long, quantity long, net_item_amount decimal(38,4), "
       "gross_item_amount decimal(38,2), item_profit decimal(38,4), profit_margin_percentage double, "
       "product_name string, category_id int, category_name string, subcategory_id int, subcategory_name string, "
       "brand_id int, brand_name string, supplier_id long, supplier_name string, "
       "order_customer_id long, order_date date")


def oid_row(order_id, pid, net, cat=1, brand="B1", customer=None, date=D(2023, 6, 1)):
    n = None if net is None else Decimal(net)
    customer = order_id if customer is None else customer
    return (order_id, pid, 1, n, n, n, 10.0, f"p{pid}", cat, f"c{cat}", 1, "s", 1, brand, 1, "sup", customer, date)


def test_product_ranks_reviews_and_stock(spark):
    oid = spark.createDataFrame(
        [oid_row(1, 10, "50"), oid_row(2, 11, "50"), oid_row(2, 12, "20"), oid_row(1, 13, "99", cat=2)], OID
    )
    reviews = spark.createDataFrame([(10, 1, 4, D(2023, 6, 5))],
                                    "product_id long, customer_id long, review_rating long, review_date date")
    inventory = spark.createDataFrame([(10, 1, 3, 10), (10, 3, 1, 10)],
                                      "product_id long, warehouse_id int, inventory_level long, reorder_point int")
    warehouses = spark.createDataFrame([(1, True), (3, False)], "warehouse_id int, is_active boolean")
    out = {r["product_id"]: r for r in
           orders.product_performance(oid, reviews, inventory, warehouses, D(2023, 1, 1), D(2023, 12, 31))
           .collect()}
    assert [out[p]["category_revenue_rank"] for p in (10, 11, 12)] == [1, 1, 3]  # tie, then gap
    assert out[13]["category_revenue_rank"] == 1
    assert out[13]["overall_revenue_percentile"] == 0.0
    assert out[11]["review_count"] == 0 and out[11]["average_rating"] is None
    assert out[10]["low_stock_warehouses"] == 1  # inactive warehouse 3 ignored
    assert out[11]["low_stock_warehouses"] is None


def test_missing_month_and_zero_previous_revenue(spark):
    days = [D(2023, 1, 5), D(2023, 3, 5), D(2023, 4, 5)]
    oid = spark.createDataFrame(
        [oid_row(i + 1, 10, net, customer=1, date=d) for i, (net, d) in enumerate(zip(("0", "40", "60"), days))], OID
    )
    got = rows(orders.time_based_sales(oid), "month", "prev_month_revenue", "month_over_month_growth",
               "cumulative_revenue")
    assert got == [
        (D(2023, 1, 1), None, None, Decimal("0.0000")),
        (D(2023, 3, 1), Decimal("0.0000"), None, Decimal("40.0000")),  # previous row, revenue 0 -> NULL
        (D(2023, 4, 1), Decimal("40.0000"), 50.0, Decimal("100.0000")),
    ]


def test_null_city_keeps_row_without_top_values(spark):
    cust = spark.createDataFrame([
        (1, "a", "b", "e", D(2020, 1, 1), "X", None, "p"),
        (2, "a", "b", "e", D(2020, 1, 1), "X", "c", "p"),
    ], CUST)
    cb = orders.customer_base(cust, spark.createDataFrame([], SUBS), AS_OF)
    oh = orders.order_history(
        _orders(spark, [order_row(1, 1, D(2023, 6, 1)), order_row(2, 2, D(2023, 6, 1))]),
        spark.createDataFrame([], SESS), D(2023, 1, 1), D(2023, 12, 31),
    )
    oid = spark.createDataFrame([oid_row(1, 10, "5"), oid_row(2, 11, "7", brand="B2")], OID)
    got = rows(orders.geographic_sales(cb, oh, oid), "city", "total_orders", "top_category", "top_brand")
    assert got == [("c", 1, "c1", "B2"), (None, 1, None, None)]


def test_a_name_without_known_revenue_never_leads(spark):
    lines = spark.createDataFrame(
        [("X", "c", "a", "A", None), ("X", "c", "b", "B", Decimal("5.00")), ("X", "d", "a", "A", None)],
        "country string, city string, category_name string, brand_name string, net_item_amount decimal(38,4)",
    )
    got = orders.top_names_by_revenue(lines, {"top_category": "category_name", "top_brand": "brand_name"})
    assert rows(got, "city", "top_category", "top_brand") == [("c", "b", "B"), ("d", "a", "A")]


def test_a_product_without_known_price_is_never_primary(spark):
    tx = clean(spark, [
        (1, 1, "2023-03-01 10:00:00", 11, "A", 1, None, "card", "X", "mobile", False, False),
        tx_row(2, 1, "2023-03-01 10:00:00", pid=10, price="5"),
        (3, 2, "2023-03-01 10:00:00", 11, "A", 1, None, "card", "X", "mobile", False, False),
    ])
    assert rows(commerce.primary_products(tx), "user_id", "product_id") == [(1, 10), (2, 11)]


def test_zero_unit_cost_is_an_error(spark):
    items = spark.createDataFrame([(1, 10, 1, Decimal("5.00"), 0)],
                                  "order_id long, product_id long, quantity long, unit_price decimal(18,2), "
                                  "discount_percentage int")
    products = spark.createDataFrame(
        [(10, "p", 1, 1, 1, 1, Decimal("0.00"), Decimal("1.0"), True, 10)],
        "product_id long, product_name string, category_id int, subcategory_id int, brand_id int, "
        "supplier_id long, unit_cost decimal(18,2), weight_kg decimal(10,1), is_perishable boolean, "
        "shelf_life_days int",
    )
    dims = [
        spark.createDataFrame([(1, "c")], "category_id int, category_name string"),
        spark.createDataFrame([(1, "s")], "subcategory_id int, subcategory_name string"),
        spark.createDataFrame([(1, "b")], "brand_id int, brand_name string"),
        spark.createDataFrame([(1, "s", "X")], "supplier_id long, supplier_name string, country string"),
    ]
    oh = spark.createDataFrame([(1, 1, D(2023, 6, 1))], "order_id long, customer_id long, order_date date")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|divide"):
        orders.order_items_detail(items, products, *dims, oh).collect()


COVID = (
    "date date, country_code string, country_name string, subregion1_code string, subregion1_name string, "
    "subregion2_code string, subregion2_name string, location_key string, aggregation_level int, "
    "latitude double, longitude double, location_geometry string, cumulative_confirmed long, "
    "cumulative_deceased long, cumulative_recovered long"
)


def test_leaf_level_nulls(spark):
    d = D(2020, 5, 1)
    data = [
        (d, "A", "a", None, None, None, None, "A", 0, 1.0, 2.0, "P", 10, 1, 5),
        (d, "A", "a", "A1", "a1", None, None, "A_A1", 1, 1.0, 2.0, "P", 6, 1, None),
        (d, None, "n", None, None, None, None, "N", 0, 1.0, 2.0, "P", 3, 1, 1),
        (d, "B", "b", None, None, None, None, "B", 0, 1.0, 2.0, "P", 8, 2, 3),
    ]
    out = region.leaf_level_extract(spark.createDataFrame(data, COVID))
    got = rows(out, "country_region", "province_state", "active")
    assert got == [("a", "a1", None), ("b", None, 3)]


def test_null_product_is_a_group_of_its_own(spark):
    tx = clean(spark, [
        tx_row(1, 1, "2023-03-01 10:00:00", pid=None, cat=None, device="desktop"),
        tx_row(2, 2, "2023-03-01 11:00:00", pid=None, cat=None),
        tx_row(3, 2, "2023-03-02 11:00:00", pid=5),
    ])
    pm = {r["product_id"]: r for r in commerce.product_metrics(tx).collect()}
    assert pm[None]["unique_customers"] == 2 and pm[None]["transaction_count"] == 2
    assert pm[None]["mobile_customers"] == 1 and pm[None]["desktop_customers"] == 1
    assert pm[5]["unique_customers"] == 1
