"""State calendar of open items: aging and dunning of any day from one table.

An open item passes through dated states: it enters on its invoice date as not
due, changes bucket or dunning level a fixed number of days after its due date,
and leaves on its expected clearing date.  Each stay in a state is a delta of
plus one item on its first day and minus one on the day after its last.  Deltas
are additive, so the calendar is the items aggregated by (day, company,
segment, bucket, level): its size follows the days, not the items.  The open
items of a day are the sum of all deltas up to it, and a series over many days
one running sum, where status columns would have to be recomputed from all
items for each day.

Items are first counted by their dates, and only those groups are spread over
the states.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values (must equal the status rules of plans.items) -----------
# (days after the due date from which the state holds, bucket, dunning level)
AR_STATES = [(None, "Not Due", 0), (1, "1-30", 1), (16, "1-30", 2), (31, "31-60", 2), (46, "31-60", 3), (61, "61-90", 3),
             (91, "90+", 3)]
AP_STATES = [(None, "Not Due", None), (1, "1-30", None), (31, "31-60", None), (61, "60+", None)]
# -------------------------------------------------------------------------


@dataclass(frozen=True)
class Side:
    states: list
    leaves: str      # column of the date on which an item is open no more
    group: str


SIDES = {"ar": Side(AR_STATES, "expected_clearing_date", "segment"),
         "ap": Side(AP_STATES, "expected_payment_date", "supplier_segment")}
KEYS = ["company", "segment", "bucket", "level"]


def state_deltas(core: DataFrame, side: str) -> DataFrame:
    """``(day, company, segment, bucket, level, amount, items)``: changes of
    the open items on each day, from a core table (before any as-of date)."""
    s = SIDES[side]
    dates = core.groupBy("company", F.col(s.group).alias("segment"), "invoice_date", "due_date",
                         F.col(s.leaves).alias("leaves")).agg(F.sum("amount_usd").alias("amount"),
                                                              F.count(F.lit(1)).alias("items"))

    def begin(days: int | None) -> Column:
        if days is None:
            return F.col("invoice_date")
        return F.greatest(F.date_add("due_date", days), F.col("invoice_date"))

    stays = []
    for at, (days, bucket, level) in enumerate(s.states):
        until = F.col("leaves") if at + 1 == len(s.states) else F.least(begin(s.states[at + 1][0]), F.col("leaves"))
        stays.append(F.struct(F.lit(bucket).alias("bucket"), F.lit(level).cast("int").alias("level"),
                              begin(days).alias("first"), until.alias("until")))
    stay = dates.select("company", "segment", "amount", "items", F.explode(F.array(*stays)).alias("s"))
    stay = stay.filter(F.col("s.first") < F.col("s.until"))
    change = F.explode(F.array(F.struct(F.col("s.first").alias("day"), F.lit(1).alias("sign")),
                               F.struct(F.col("s.until").alias("day"), F.lit(-1).alias("sign")))).alias("c")
    moved = stay.select("company", "segment", F.col("s.bucket").alias("bucket"), F.col("s.level").alias("level"), "amount",
                        "items", change)
    return moved.groupBy(F.col("c.day").alias("day"), *KEYS).agg(
        F.sum(F.col("amount") * F.col("c.sign")).cast("decimal(28,2)").alias("amount"),
        F.sum(F.col("items") * F.col("c.sign")).alias("items"))


def open_at(calendar: DataFrame, day: dt.date) -> DataFrame:
    """``(company, segment, bucket, level, amount, items)``: the open items of
    any day."""
    held = calendar.filter(F.col("day") <= F.lit(day)).groupBy(*KEYS)
    return (held.agg(F.sum("amount").cast("decimal(28,2)").alias("amount"), F.sum("items").alias("items"))
            .filter(F.col("items") > 0))


def month_ends(first: dt.date, last: dt.date) -> Column:
    """Array of the month ends from the month of ``first`` up to ``last``."""
    months = F.sequence(F.trunc(F.lit(first), "month"), F.lit(last), F.expr("interval 1 month"))
    return F.filter(F.transform(months, F.last_day), lambda m: m <= F.lit(last))


def series(calendar: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """``(month_end, company, segment, bucket, level, amount, items)``: the open
    items of every month end, by one running sum over the months' changes."""
    changes = (calendar.filter(F.col("day") <= F.lit(last))
               .groupBy(F.greatest(F.last_day("day"), F.last_day(F.lit(first))).alias("month_end"), *KEYS)
               .agg(F.sum("amount").alias("amount"), F.sum("items").alias("items")))
    # month ends without a change carry the sum on; months x keys rows
    grid = changes.select(*KEYS).distinct().select(F.explode(month_ends(first, last)).alias("month_end"), *KEYS,
                                                   F.lit(0).alias("amount"), F.lit(0).alias("items"))
    full = changes.unionByName(grid).groupBy("month_end", *KEYS).agg(F.sum("amount").alias("amount"),
                                                                    F.sum("items").alias("items"))
    so_far = Window.partitionBy(*KEYS).orderBy("month_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (full.select("month_end", *KEYS, F.sum("amount").over(so_far).cast("decimal(28,2)").alias("amount"),
                        F.sum("items").over(so_far).alias("items")).filter(F.col("items") > 0))


def _by(wh, side: str, column: str) -> DataFrame:
    calendar = wh.ar_calendar if side == "ar" else wh.ap_calendar
    every = series(calendar, wh.params.history_start, wh.params.as_of)
    return every.groupBy("month_end", "company", F.col(column).alias("name")).agg(
        F.sum("amount").alias("amount"), F.sum("items").alias("items")).withColumn("side", F.lit(side))


def aging_series(wh) -> DataFrame:
    """Open receivables and payables by aging bucket at every month end."""
    return _by(wh, "ar", "bucket").unionByName(_by(wh, "ap", "bucket"))


def dunning_series(wh) -> DataFrame:
    """Open receivables by dunning level at every month end."""
    return _by(wh, "ar", "level").withColumn("name", F.concat(F.lit("Level "), F.col("name").cast("string"))).drop("side")
