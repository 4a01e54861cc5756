"""Distributed operators against brute force."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.dense_index import dense_index
from ledgerlens.plans.flows import monthly_flows


def test_dense_index_equals_global_row_number(spark):
    rnd = random.Random(7)
    ids = sorted({str(rnd.randint(1, 100000)) for _ in range(3000)})
    rnd.shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "partner_id string").repartition(5)
    got = {r["partner_id"]: r["rn"] for r in dense_index(df, "partner_id", "rn", num_partitions=7).collect()}
    want = {v: i + 1 for i, v in enumerate(sorted(ids))}   # string order, as row_number() over (order by id)
    assert got == want


def _random_core(spark, n, seed):
    rnd = random.Random(seed)
    base = dt.date(2000, 1, 1)
    ar, ap = [], []
    for k in range(n):
        inv = base + dt.timedelta(days=rnd.randint(0, 500))
        due = inv + dt.timedelta(days=rnd.choice([30, 45, 60]))
        exp = inv + dt.timedelta(days=rnd.randint(20, 200))
        comp = rnd.choice(["1000", "2100", "5000"])
        amt = round(rnd.uniform(1, 10000), 2)
        ar.append((comp, inv, due, exp, amt))
        ap.append((comp, inv, due, inv + dt.timedelta(days=rnd.randint(5, 120)), amt / 2, 0.0, 0.0))
    ar_df = spark.createDataFrame(ar, "company_code string, invoice_date date, due_date date, "
                                      "expected_clearing_date date, amount_usd double") \
        .withColumn("amount_usd", F.col("amount_usd").cast("decimal(18,2)"))
    ap_df = spark.createDataFrame(ap, "company_code string, invoice_date date, due_date date, "
                                      "expected_payment_date date, amount_usd double, discount_captured_usd double, "
                                      "discount_lost_usd double")
    for c in ("amount_usd", "discount_captured_usd", "discount_lost_usd"):
        ap_df = ap_df.withColumn(c, F.col(c).cast("decimal(18,2)"))
    return ar_df, ap_df


def test_event_delta_balances_equal_interval_join(spark):
    ar, ap = _random_core(spark, 800, 3)
    hist = dt.date(2000, 3, 1)
    got = monthly_flows(ar, ap, hist, dt.date(9999, 12, 31)).toPandas().set_index(["company_code", "month_end"]).sort_index()
    a, p = ar.toPandas(), ap.toPandas()
    me = lambda d: (pd.Timestamp(d) + pd.offsets.MonthEnd(0)).date()
    months = sorted({(r.company_code, me(r.invoice_date)) for r in a.itertuples() if r.invoice_date >= hist})
    assert len(got) == len(months)
    for comp, m in months:
        aa = a[(a.company_code == comp) & (a.invoice_date <= m) & (a.expected_clearing_date > m)]
        pp = p[(p.company_code == comp) & (p.invoice_date <= m) & (p.expected_payment_date > m)]
        row = got.loc[(comp, m)]
        assert row.ar_balance_usd == sum(aa.amount_usd)
        assert row.ar_overdue_usd == sum(aa[aa.due_date < m].amount_usd)
        assert row.ap_balance_usd == sum(pp.amount_usd)
        assert row.revenue_usd == sum(a[(a.company_code == comp) & (a.invoice_date.map(me) == m)].amount_usd)


def test_running_window_is_by_rows(spark):
    from ledgerlens.plans.kpi import _trailing
    df = spark.createDataFrame([("1000", dt.date(2001, 1, 31), 1), ("1000", dt.date(2001, 2, 28), 2),
                                ("1000", dt.date(2001, 4, 30), 4)], "company_code string, month_end date, v int")
    got = df.select("month_end", F.sum("v").over(_trailing()).alias("s")).orderBy("month_end").collect()
    assert [r.s for r in got] == [1, 3, 7]   # the gap month (March) does not shorten the window
    assert Window is not None


def test_split_join_equals_plain_join_with_hot_key(spark):
    from ledgerlens.operators.skew_join import hot_keys, split_join
    rows = [("hot" if i % 3 == 0 else f"k{i % 97}", i) for i in range(3000)]   # one key holds a third
    fact = spark.createDataFrame(rows, "key string, v int")
    dim = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"n{i}") for i in range(97)], "key string, name string")
    assert hot_keys(fact, "key", share=0.01) == ["hot"]
    got = split_join(fact, dim, "key", share=0.01)
    want = fact.join(dim, "key")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # the rule is the same at every size: at the default share all 98 keys are hot, and the join is the same
    assert len(hot_keys(fact, "key")) == 98
    whole = split_join(fact, dim, "key")
    assert whole.exceptAll(want).count() == 0 and want.exceptAll(whole).count() == 0
