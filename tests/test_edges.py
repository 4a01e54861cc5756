"""Hand-made edge rows (FIXTURES F4)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import TEST_PARAMS
from ledgerlens.functions.filters import Filter
from ledgerlens.plans import items
from ledgerlens.plans.flows import monthly_flows
from ledgerlens.sources.journal import JOURNAL_SCHEMA
from ledgerlens.sources.literals import dim_company

AS_OF = TEST_PARAMS.as_of
D = dt.timedelta


def _ar_core(spark, rows):
    """rows: (doc, invoice_date, due_date, expected_clearing_date, bucket)."""
    data = [("1000", "US Operations", 2001, doc, "C1", "Apex Industries", "Enterprise", "Low", "", "USD", "NT30", 30,
             inv, inv.strftime("%Y-%m"), due, exp, Decimal("100.00"), Decimal("100.00"), h)
            for doc, inv, due, exp, h in rows]
    schema = ("company_code string, company string, fiscal_year int, document_id string, customer_id string, "
              "customer_name string, segment string, credit_risk string, profit_center string, currency string, "
              "payment_terms string, terms_days int, invoice_date date, invoice_month string, due_date date, "
              "expected_clearing_date date, amount_lc decimal(18,2), amount_usd decimal(18,2), item_bucket int")
    return spark.createDataFrame(data, schema)


def _status(spark, rows):
    return {r.document_id: r for r in items.ar_status(_ar_core(spark, rows), AS_OF).collect()}


def test_due_on_as_of_is_not_due(spark):
    r = _status(spark, [("a", AS_OF - D(30), AS_OF, AS_OF + D(5), 50)])["a"]
    assert (r.aging_bucket, r.days_past_due, r.dunning_level, r.is_open) == ("Not Due", 0, 0, True)


@pytest.mark.parametrize("dpd,level", [(15, 1), (16, 2), (45, 2), (46, 3)])
def test_dunning_levels(spark, dpd, level):
    r = _status(spark, [("a", AS_OF - D(200), AS_OF - D(dpd), AS_OF + D(3), 50)])["a"]
    assert r.days_past_due == dpd and r.dunning_level == level


@pytest.mark.parametrize("dpd,bucket,ap_bucket", [(30, "1-30", "1-30"), (31, "31-60", "31-60"), (60, "31-60", "31-60"),
                                                   (61, "61-90", "60+"), (90, "61-90", "60+"), (91, "90+", "60+")])
def test_aging_buckets(spark, dpd, bucket, ap_bucket):
    r = _status(spark, [("a", AS_OF - D(300), AS_OF - D(dpd), AS_OF + D(3), 50)])["a"]
    assert r.aging_bucket == bucket
    core = _ap_core_row(spark, AS_OF - D(300), AS_OF - D(dpd), AS_OF + D(3))
    assert items.ap_status(core, AS_OF).first().aging_bucket == ap_bucket


def _ap_core_row(spark, inv, due, exp):
    cols = [c for c in items.AP_COLUMNS if c not in ("payment_date", "is_open", "days_past_due", "days_to_pay",
                                                      "paid_on_time", "aging_bucket")]
    vals = {"company_code": "1000", "company": "US Operations", "fiscal_year": 2001, "document_id": "L1-1",
            "supplier_id": "7", "supplier_name": "Coho Metals", "category": "Utilities", "supplier_segment": "Core",
            "early_pay_program": "Standard", "payment_terms": "NT30", "terms_days": 30,
            "payment_outcome": "Paid at Terms", "currency": "USD", "invoice_date": inv,
            "invoice_month": inv.strftime("%Y-%m"), "due_date": due, "expected_payment_date": exp,
            "supplier_funded_date": None, "amount_lc": Decimal("10.00"), "amount_usd": Decimal("10.00"),
            "paid_early_no_benefit": False, "discount_captured_usd": Decimal("0"), "discount_lost_usd": Decimal("0"),
            "dd_opportunity_usd": Decimal("0"), "scf_funded_usd": Decimal("0")}
    types = {"fiscal_year": "int", "terms_days": "int", "invoice_date": "date", "due_date": "date",
             "expected_payment_date": "date", "supplier_funded_date": "date", "paid_early_no_benefit": "boolean"}
    schema = ", ".join(f"{c} {types.get(c, 'decimal(18,2)' if c.endswith('_usd') or c == 'amount_lc' else 'string')}"
                       for c in cols)
    return spark.createDataFrame([tuple(vals[c] for c in cols)], schema)


def test_clearing_on_as_of_is_cleared(spark):
    r = _status(spark, [("a", AS_OF - D(40), AS_OF - D(10), AS_OF, 50)])["a"]
    assert r.is_open is False and r.clearing_date == AS_OF and r.paid_on_time is False and r.aging_bucket == "Cleared"


def test_balance_month_end_edges(spark):
    m = dt.date(2001, 2, 28)
    ar = _ar_core(spark, [
        ("clears_on_m", dt.date(2001, 1, 10), dt.date(2001, 2, 9), m, 50),           # cleared at m: not in balance
        ("due_on_m", dt.date(2001, 1, 29), m, dt.date(2001, 4, 2), 50),              # due = m: not overdue at m
    ])
    ap = spark.createDataFrame([], "company_code string, invoice_date date, due_date date, "
                                   "expected_payment_date date, amount_usd decimal(18,2), "
                                   "discount_captured_usd decimal(18,2), discount_lost_usd decimal(18,2)")
    f = {r.month_end: r for r in monthly_flows(ar, ap, dt.date(2000, 1, 1), AS_OF).collect()}
    assert f[dt.date(2001, 1, 31)].ar_balance_usd == Decimal("200.00")
    # at February month end only the second item is open, and it is due that day, so not overdue
    assert dt.date(2001, 2, 28) not in f   # no AR invoice in February: not a spine month
    ar2 = ar.unionByName(_ar_core(spark, [("feb", dt.date(2001, 2, 3), dt.date(2001, 3, 5), dt.date(2001, 3, 9), 1),
                                          ("mar", dt.date(2001, 3, 2), dt.date(2001, 4, 1), dt.date(2001, 4, 10), 1)]))
    f2 = {r.month_end: r for r in monthly_flows(ar2, ap, dt.date(2000, 1, 1), AS_OF).collect()}
    assert f2[m].ar_balance_usd == Decimal("200.00")   # due_on_m + feb
    assert f2[m].ar_overdue_usd == Decimal("0.00")
    assert f2[dt.date(2001, 3, 31)].ar_balance_usd == Decimal("200.00")   # due_on_m + mar
    assert f2[dt.date(2001, 3, 31)].ar_overdue_usd == Decimal("100.00")   # due_on_m overdue at March end


def test_month_with_ap_only_absent(spark):
    ar = _ar_core(spark, [("a", dt.date(2001, 1, 10), dt.date(2001, 2, 9), dt.date(2001, 2, 20), 1)])
    ap = spark.createDataFrame([("1000", dt.date(2001, 3, 5), dt.date(2001, 4, 4), dt.date(2001, 4, 4),
                                 Decimal("5.00"), Decimal("0"), Decimal("0"))],
                               "company_code string, invoice_date date, due_date date, expected_payment_date date, "
                               "amount_usd decimal(18,2), discount_captured_usd decimal(18,2), "
                               "discount_lost_usd decimal(18,2)")
    months = [r.month_end for r in monthly_flows(ar, ap, dt.date(2000, 1, 1), AS_OF).collect()]
    assert months == [dt.date(2001, 1, 31)]


def _journal(spark, rows):
    return spark.createDataFrame(rows, JOURNAL_SCHEMA)


def _line(comp, doc, cust, supp, dc, amount="10.00"):
    return (comp, 2001, doc, cust, supp, dt.date(2001, 5, 1), "USD", Decimal(amount), dc, "")


def test_extract_filters_and_duplicates(spark):
    j = _journal(spark, [_line("1000", "O1", "5", "", "S"), _line("1000", "O1", "5", "", "S"),   # duplicate doc
                         _line("1000", "R1", "5", "", "H"),                                         # customer credit
                         _line("1000", "L1", "", "9", "S", "-3.00"),                                # supplier debit
                         _line("1000", "L2", "", "9", "H", "-4.00")])
    assert items.ar_base(j).count() == 2
    ap = items.ap_base(j).collect()
    assert len(ap) == 1 and ap[0].amount_lc == Decimal("4.00")


def test_unknown_company_dropped_and_names_repeat(spark):
    from ledgerlens.plans.dims import dim_customer
    rows = [_line("1000", f"O{i}", f"{i:04d}", "", "S") for i in range(1, 93)] + [_line("9999", "O0", "0001", "", "S")]
    j = _journal(spark, rows)
    dc = dim_customer(j)
    names = {r.customer_id: r.customer_name for r in dc.collect()}
    assert names["0001"] == names["0092"]          # rn 1 and rn 92 share a name (13 x 7 = 91)
    core = items.ar_core(j, dc, dim_company(spark))
    assert core.filter("company_code = '9999'").count() == 0
    assert core.count() == 92


def test_zero_revenue_dso_null_and_forecast_cap(spark, wh):
    from ledgerlens.plans.kpi import inventory_monthly, wc_monthly_kpi
    months = [dt.date(2001, 1, 31), dt.date(2001, 2, 28), dt.date(2001, 3, 31)]
    flows = spark.createDataFrame(
        [("1000", m, m.strftime("%Y-%m"), Decimal("0"), Decimal("5"), Decimal("7"), Decimal("0"), Decimal("3"),
          Decimal("0"), Decimal("0")) for m in months],
        "company_code string, month_end date, month string, revenue_usd decimal(18,2), purchases_usd decimal(18,2), "
        "ar_balance_usd decimal(18,2), ar_overdue_usd decimal(18,2), ap_balance_usd decimal(18,2), "
        "discount_captured_usd decimal(18,2), discount_lost_usd decimal(18,2)")
    inv = inventory_monthly(flows, wh.dim_company)
    k = wc_monthly_kpi(flows, inv, wh.dim_company, dt.date(2000, 1, 1)).collect()
    assert all(r.dso is None and r.dio is None and r.ccc is None for r in k)
    assert all(r.dpo is not None for r in k)
    # forecast: an open item expected 20 weeks out lands in week 13
    from ledgerlens.plans.cash import _forecast_week
    d = spark.createDataFrame([(AS_OF + D(140),), (AS_OF + D(1),), (AS_OF + D(7),), (AS_OF + D(8),)], "e date")
    assert [r[0] for r in d.select(_forecast_week("e", TEST_PARAMS)).collect()] == [13, 1, 1, 2]


def test_open_dd_discount_counted(spark, wh):
    dd_open = wh.ap_items.filter("payment_outcome = 'DD Accepted' AND is_open")
    if dd_open.count() == 0:
        pytest.skip("no open DD item at this scale")
    r = dd_open.agg(F.sum("discount_captured_usd").alias("c"), F.count("days_to_pay").alias("n")).first()
    assert r.c > 0 and r.n == 0


def test_reversed_and_malformed_period():
    f = Filter.build("", "2001-03", "2000-11", default_from="2000-08", default_to="2001-07")
    assert (f.month_from, f.month_to) == ("2000-11", "2001-03")
    g = Filter.build("", "nonsense", "2001-13", default_from="2000-08", default_to="2001-07")
    assert (g.month_from, g.month_to) == ("2000-08", "2001-07")
