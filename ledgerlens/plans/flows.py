"""Monthly company flows: revenue, purchases, discounts and month-end
open AR / overdue AR / AP balances.

One pass over AR and AP items sums them by company and the few months their
events fall in, with map-side partial aggregation; each such group emits a few
event rows, which one aggregation by (company, month end) collapses to
companies x months rows; a running sum over those rows gives the balances (see
``operators.interval_balance``).  The spine is the
months with AR invoices on or after the history start, so months with AP
only do not appear.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.calendar import first_month_end_after, month_str
from ledgerlens.functions.measures import MONEY
from ledgerlens.operators.interval_balance import event_struct, explode_events, opened_closed, running_total

_DEC = T.DecimalType(28, 2)  # sums of money over many items
EVENT_SCHEMA = T.StructType([
    T.StructField("month_end", T.DateType()),
    T.StructField("revenue", _DEC),
    T.StructField("purchases", _DEC),
    T.StructField("captured", _DEC),
    T.StructField("lost", _DEC),
    T.StructField("ar_delta", _DEC),
    T.StructField("od_delta", _DEC),
    T.StructField("ap_delta", _DEC),
    T.StructField("spine", T.IntegerType()),
])

FLOW_COLUMNS = ["company_code", "month_end", "month", "revenue_usd", "purchases_usd", "ar_balance_usd",
                "ar_overdue_usd", "ap_balance_usd", "discount_captured_usd", "discount_lost_usd"]


def ar_events(ar: DataFrame, history_start: dt.date) -> DataFrame:
    mi = F.last_day("invoice_date")
    # overdue at month end m needs due < m: first such m is the month end after the due date
    od = F.greatest(first_month_end_after("due_date"), mi)
    months = ar.groupBy("company_code", mi.alias("mi"), F.last_day("expected_clearing_date").alias("mx"),
                        od.alias("od")).agg(
        F.sum("amount_usd").alias("amount"),
        F.max(F.when(F.col("invoice_date") >= F.lit(history_start), 1).otherwise(0)).alias("spine"))
    a, mi, spine = F.col("amount"), F.col("mi"), F.col("spine")
    bal_in, bal_out = opened_closed(mi, F.col("mx"))
    od_in, od_out = opened_closed(F.col("od"), F.col("mx"))
    events = [
        event_struct(mi, {"revenue": a, "spine": spine}, EVENT_SCHEMA),
        event_struct(bal_in, {"ar_delta": a}, EVENT_SCHEMA),
        event_struct(bal_out, {"ar_delta": -a}, EVENT_SCHEMA),
        event_struct(od_in, {"od_delta": a}, EVENT_SCHEMA),
        event_struct(od_out, {"od_delta": -a}, EVENT_SCHEMA),
    ]
    return explode_events(months, ["company_code"], events)


def ap_events(ap: DataFrame) -> DataFrame:
    months = ap.groupBy("company_code", F.last_day("invoice_date").alias("mi"),
                        F.last_day("expected_payment_date").alias("mx")).agg(
        F.sum("amount_usd").alias("amount"), F.sum("discount_captured_usd").alias("captured"),
        F.sum("discount_lost_usd").alias("lost"))
    a, mi = F.col("amount"), F.col("mi")
    bal_in, bal_out = opened_closed(mi, F.col("mx"))
    events = [
        event_struct(mi, {"purchases": a, "captured": F.col("captured"), "lost": F.col("lost")}, EVENT_SCHEMA),
        event_struct(bal_in, {"ap_delta": a}, EVENT_SCHEMA),
        event_struct(bal_out, {"ap_delta": -a}, EVENT_SCHEMA),
    ]
    return explode_events(months, ["company_code"], events)


def monthly_deltas(ar: DataFrame, ap: DataFrame, history_start: dt.date) -> DataFrame:
    """Per (company, month end) sums of flows and balance deltas."""
    ev = ar_events(ar, history_start).unionByName(ap_events(ap))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)
    return (ev.groupBy("company_code", "month_end")
              .agg(z("revenue").alias("revenue_usd"), z("purchases").alias("purchases_usd"),
                   z("captured").alias("discount_captured_usd"), z("lost").alias("discount_lost_usd"),
                   z("ar_delta").alias("ar_delta"), z("od_delta").alias("od_delta"),
                   z("ap_delta").alias("ap_delta"),
                   F.coalesce(F.max("spine"), F.lit(0)).alias("spine")))


def flows_from_deltas(deltas: DataFrame, as_of: dt.date) -> DataFrame:
    """Flows and balances of the spine's months that had ended by ``as_of``."""
    bal = running_total(deltas, ["company_code"], "month_end",
                        {"ar_balance_usd": "ar_delta", "ar_overdue_usd": "od_delta", "ap_balance_usd": "ap_delta"})
    return (bal.filter((F.col("spine") == 1) & (F.col("month_end") <= F.lit(as_of)))
               .select("company_code", "month_end", month_str("month_end").alias("month"),
                       "revenue_usd", "purchases_usd",
                       F.col("ar_balance_usd").cast(MONEY).alias("ar_balance_usd"),
                       F.col("ar_overdue_usd").cast(MONEY).alias("ar_overdue_usd"),
                       F.col("ap_balance_usd").cast(MONEY).alias("ap_balance_usd"),
                       "discount_captured_usd", "discount_lost_usd"))


def monthly_flows(ar_core: DataFrame, ap_core: DataFrame, history_start: dt.date, as_of: dt.date) -> DataFrame:
    """Reads the core tables; what was posted after ``as_of`` touches only later
    months."""
    by_then = F.col("invoice_date") <= F.lit(as_of)
    return flows_from_deltas(monthly_deltas(ar_core.filter(by_then), ap_core.filter(by_then), history_start), as_of)
