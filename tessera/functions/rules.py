"""Business rules of the reference queries: tier tables and labels.

Each rule is a list of (predicate, label) branches evaluated in order - the
first matching branch wins, as in a searched CASE - and compiled to one
``CASE WHEN`` expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(value: Column, bounds: Sequence[tuple[float, object]], default: object, op: str = ">=") -> Column:
    """``CASE WHEN value <op> b1 THEN l1 WHEN value <op> b2 THEN l2 ... ELSE default``."""
    compare = {
        ">=": lambda b: value >= b,
        ">": lambda b: value > b,
        "<=": lambda b: value <= b,
    }[op]
    expr = None
    for bound, label in bounds:
        cond = compare(F.lit(bound))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def first_match(branches: Sequence[tuple[Column, object]], default: object) -> Column:
    expr = None
    for cond, label in branches:
        lab = label if isinstance(label, Column) else F.lit(label)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


# Fixed values (must equal the reference queries' constants).
# Recency score from days since the last purchase: <=30 -> 5, <=60 -> 4, <=90 -> 3, <=180 -> 2, else 1.
RECENCY_SCORE = ((30, 5), (60, 4), (90, 3), (180, 2))
# Frequency score from distinct transactions: >=20 -> 5, >=10 -> 4, >=5 -> 3, >=2 -> 2, else 1.
FREQUENCY_SCORE = ((20, 5), (10, 4), (5, 3), (2, 2))
# Monetary score from spend: >=1000 -> 5, >=500 -> 4, >=200 -> 3, >=50 -> 2, else 1.
MONETARY_SCORE = ((1000, 5), (500, 4), (200, 3), (50, 2))
# Value tier from spend.
VALUE_TIER = ((1000, "Platinum"), (500, "Gold"), (200, "Silver"))
VALUE_TIER_DEFAULT = "Bronze"
# Churn risk from days since the last purchase (strictly greater).
CHURN_RISK = ((180, "High Risk"), (90, "Medium Risk"), (30, "Low Risk"))
CHURN_RISK_DEFAULT = "Active"
# Category behaviour from the number of distinct categories: >=5, >=3, =2, else.
CATEGORY_BEHAVIOR = ((5, "Multi-Category"), (3, "Several Categories"))
CATEGORY_BEHAVIOR_TWO = "Two Categories"
CATEGORY_BEHAVIOR_DEFAULT = "Single Category"
# Lifetime value multipliers by segment (others 0.5).
LIFETIME_FACTOR = (
    ("Champions", "1.5"),
    ("Loyal Customers", "1.2"),
    ("Potential Loyalists", "1.1"),
    ("New Customers", "0.8"),
)
LIFETIME_FACTOR_DEFAULT = "0.5"
# Season of the last purchase by month.
HOLIDAY_MONTHS = (11, 12)
SUMMER_MONTHS = (6, 7)
# Device buckets.
MOBILE_DEVICES = ("mobile", "tablet")


def category_behavior(n: Column) -> Column:
    branches = [(n >= bound, label) for bound, label in CATEGORY_BEHAVIOR] + [(n == 2, CATEGORY_BEHAVIOR_TWO)]
    return first_match(branches, CATEGORY_BEHAVIOR_DEFAULT)


def season(month: Column) -> Column:
    return first_match(
        [(month.isin(*HOLIDAY_MONTHS), "Holiday Season"), (month.isin(*SUMMER_MONTHS), "Summer Season")],
        "Regular Season",
    )


def recency_score(days: Column) -> Column:
    return tier(days, RECENCY_SCORE, 1, op="<=")


def frequency_score(n: Column) -> Column:
    return tier(n, FREQUENCY_SCORE, 1)


def monetary_score(spend: Column) -> Column:
    return tier(spend, MONETARY_SCORE, 1)


def rfm_segment(total: Column, r: Column, f: Column, m: Column) -> Column:
    """Eight-way label from the RFM scores (first match wins)."""
    return first_match(
        [
            (total >= 13, "Champions"),
            (total >= 11, "Loyal Customers"),
            (total >= 9, "Potential Loyalists"),
            (r >= 4, "New Customers"),
            ((r <= 2) & (f >= 3), "At Risk"),
            ((r <= 2) & (f <= 2), "Hibernating"),
            (m >= 4, "Big Spenders"),
        ],
        "Need Attention",
    )


def device_bucket(device: Column) -> Column:
    return first_match([(device.isin(*MOBILE_DEVICES), "mobile"), (device == "desktop", "desktop")], "other")


def tile_segment(recency: Column, monetary: Column, frequency: Column) -> Column:
    """Seven-way label from the recency label and the money / frequency tiles."""
    lost = recency.isin("Lapsed", "Churned")
    return first_match(
        [
            ((recency == "Active") & (monetary >= 4) & (frequency >= 4), "Champions"),
            ((recency == "Active") & (monetary >= 3) & (frequency >= 3), "Loyal Customers"),
            ((recency == "Active") & (monetary <= 2) & (frequency <= 2), "Promising"),
            ((recency == "At Risk") & (monetary >= 4) & (frequency >= 4), "At Risk Champions"),
            (lost & (monetary >= 4) & (frequency >= 4), "Lost Champions"),
            (lost & (monetary <= 2) & (frequency <= 2), "Lost Cause"),
        ],
        "Needs Attention",
    )


def recency_label(days: Column) -> Column:
    """Active (<=30), At Risk (31-90), Lapsed (91-180), else Churned."""
    return first_match(
        [(days <= 30, "Active"), (days.between(31, 90), "At Risk"), (days.between(91, 180), "Lapsed")],
        "Churned",
    )


def round_half_up(x: Column, digits: int) -> Column:
    """Round a DOUBLE half up on its binary value: ``floor(x * 10^d + 0.5) / 10^d``.

    Spelled out because engines differ on halfway cases of ``round`` for
    doubles (some round the shortest decimal text, others the binary value);
    this form gives identical results in every IEEE engine. Beyond 2^52 / 10^d
    a DOUBLE has no digit left to round, and is returned as it is (``floor``
    makes a BIGINT, which could not hold it)."""
    scale = float(10**digits)
    rounded = F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(F.abs(x) < F.lit(2.0**52 / scale), rounded).otherwise(x)
