"""The state calendar against the status rules at single days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import items as IT
from ledgerlens.plans import state_calendar as ST


def direct(core, side, day):
    items = (IT.ar_status if side == "ar" else IT.ap_status)(core, day).filter("is_open")
    level = F.coalesce("dunning_level", F.lit(0)) if side == "ar" else F.lit(None).cast("int")
    rows = items.groupBy("company", F.col(ST.SIDES[side].group).alias("segment"), F.col("aging_bucket").alias("bucket"),
                         level.alias("level")).agg(F.sum("amount_usd").alias("amount"), F.count(F.lit(1)).alias("items"))
    return {(r.company, r.segment, r.bucket, r.level): (r.amount, r["items"]) for r in rows.collect()}


def held(calendar, day):
    return {(r.company, r.segment, r.bucket, r.level): (r.amount, r["items"]) for r in ST.open_at(calendar, day).collect()}


@pytest.mark.parametrize("day", [dt.date(1995, 1, 3), dt.date(1998, 2, 28), dt.date(2001, 5, 17), dt.date(2001, 7, 31)])
def test_any_day_equals_a_recomputation(wh, day):
    assert held(wh.ar_calendar, day) == direct(wh.ar_core, "ar", day)
    assert held(wh.ap_calendar, day) == direct(wh.ap_core, "ap", day)


def test_edges_of_states_on_made_up_items(spark):
    """Every day around each state change; items cleared before they are due,
    on the day they come in, or due before it."""
    rng, day = random.Random(1), dt.date(2020, 1, 31)
    rows = [("c", "s", day, day + dt.timedelta(due), day + dt.timedelta(leaves), 1)
            for due, leaves in [(0, 200), (30, 31), (30, 30), (30, 10), (5, 5 + 91), (5, 5 + 16), (5, 0), (-40, 60), (-200, 9)]]
    rows += [("c", "s", day + dt.timedelta(rng.randrange(50)), day + dt.timedelta(rng.randrange(-50, 100)),
              day + dt.timedelta(rng.randrange(-10, 220)), 1) for _ in range(40)]
    core = spark.createDataFrame(rows, "company string, segment string, invoice_date date, due_date date, "
                                       "expected_clearing_date date, amount_usd int")
    core = core.withColumn("amount_usd", F.col("amount_usd").cast("decimal(18,2)"))
    calendar = ST.state_deltas(core, "ar").cache()
    deltas = [(r.day, r.bucket, r.level, r["items"]) for r in calendar.collect()]

    def state(due, at):
        late = (at - due).days
        bucket = next(b for most, b in [(0, "Not Due"), (30, "1-30"), (60, "31-60"), (90, "61-90"), (10 ** 9, "90+")]
                      if late <= most)
        return bucket, next(v for most, v in [(0, 0), (15, 1), (45, 2), (10 ** 9, 3)] if late <= most)

    for n in range(-5, 240):
        at, got, expected = day + dt.timedelta(n), {}, {}
        for d, bucket, level, items in deltas:
            if d <= at:
                got[bucket, level] = got.get((bucket, level), 0) + items
        for _, _, invoice, due, leaves, _ in rows:
            if invoice <= at < leaves:
                expected[state(due, at)] = expected.get(state(due, at), 0) + 1
        assert {k: v for k, v in got.items() if v} == expected, at


def test_empty(spark):
    core = spark.createDataFrame([], "company string, supplier_segment string, invoice_date date, due_date date, "
                                     "expected_payment_date date, amount_usd decimal(18,2)")
    calendar = ST.state_deltas(core, "ap")
    assert calendar.count() == 0 and ST.series(calendar, dt.date(2020, 1, 1), dt.date(2020, 6, 30)).count() == 0
