"""Job parameters. ``CURRENT_DATE()`` of the reference is the explicit
``as_of`` date everywhere, so a run is reproducible."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Params:
    as_of: dt.date = dt.date(2001, 8, 2)
    # transaction window, half-open: start <= t < end_exclusive
    tx_start: dt.date = dt.date(1995, 1, 1)
    tx_end_exclusive: dt.date = dt.date(2001, 8, 2)
    # order window, inclusive; default one year back from as_of
    analysis_start: dt.date | None = None
    analysis_end: dt.date | None = None
    customer_segment_count: int = 5
    top_limit: int = 10000
    lookback_days: int = 30
    # elements in one page of an ordered array, in the reported arrays
    page_size: int = 32
    # declared by the original script, read by none of its queries
    min_purchase_threshold: Decimal = Decimal("10.00")
    high_value_customer_threshold: Decimal = Decimal("1000.00")

    @property
    def order_start(self) -> dt.date:
        if self.analysis_start is not None:
            return self.analysis_start
        try:
            return self.as_of.replace(year=self.as_of.year - 1)
        except ValueError:  # 29 February
            return self.as_of.replace(year=self.as_of.year - 1, day=28)

    @property
    def order_end(self) -> dt.date:
        return self.analysis_end or self.as_of

    def key(self) -> tuple:
        return (
            self.as_of, self.tx_start, self.tx_end_exclusive, self.order_start, self.order_end,
            self.customer_segment_count, self.lookback_days, self.top_limit, self.page_size,
        )


DEFAULT = Params()
