"""Receivable and payable items.

Each item is one journal line (no de-duplication: the grain is the line).
The build is split in two:

* ``ar_core`` / ``ap_core``: the extract, the partner and company joins, and
  every column that does not depend on the as-of date (due and expected
  dates, amounts, payment outcome, discount economics).  This is what the
  streaming refresh appends.
* ``ar_status`` / ``ap_status``: the as-of view (open flag, clearing date,
  days past due, aging, dunning...) of the items posted by then.  A filter and
  a projection, so it is applied on read for any as-of date.

The company join is inner: lines of an unknown company code drop out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.bucket import bucket100
from ledgerlens.functions.calendar import month_str
from ledgerlens.functions.measures import MONEY
from ledgerlens.operators.skew_join import split_join

AP_SALT = "ap"

# Tasks of ``by_date`` and ``evenly``: one per FEW_ROWS lines up to MANY_TASKS, then
# as many as keep each at MOST_ROWS (some 130 MB of wide rows in the writer's sort).
FEW_ROWS, MANY_TASKS, MOST_ROWS = 100_000, 200, 400_000

AR_COLUMNS = [
    "company_code", "company", "fiscal_year", "document_id", "customer_id", "customer_name", "segment",
    "credit_risk", "profit_center", "currency", "payment_terms", "terms_days", "invoice_date", "invoice_month",
    "due_date", "expected_clearing_date", "clearing_date", "amount_lc", "amount_usd", "is_open",
    "days_past_due", "days_to_pay", "paid_on_time", "aging_bucket", "is_disputed", "dunning_level",
    "has_promise_to_pay",
]
AP_COLUMNS = [
    "company_code", "company", "fiscal_year", "document_id", "supplier_id", "supplier_name", "category",
    "supplier_segment", "early_pay_program", "payment_terms", "terms_days", "payment_outcome", "currency",
    "invoice_date", "invoice_month", "due_date", "expected_payment_date", "payment_date", "supplier_funded_date",
    "amount_lc", "amount_usd", "is_open", "days_past_due", "days_to_pay", "paid_on_time",
    "paid_early_no_benefit", "aging_bucket", "discount_captured_usd", "discount_lost_usd", "dd_opportunity_usd",
    "scf_funded_usd",
]

DD_ACCEPTED = "DD Accepted"
SCF_FUNDED = "SCF Funded"
STATIC_TAKEN = "Static Discount Taken"
STATIC_MISSED = "Static Discount Missed"
AT_TERMS = "Paid at Terms"


def _ar_lines(journal: DataFrame) -> DataFrame:
    return journal.filter((F.col("customer") != "") & (F.col("debit_credit") == "S"))


def _ap_lines(journal: DataFrame) -> DataFrame:
    return journal.filter((F.col("supplier") != "") & (F.col("debit_credit") == "H"))


def ar_base(journal: DataFrame) -> DataFrame:
    """Customer debit lines."""
    return (_ar_lines(journal)
            .select(
                "company_code", "fiscal_year",
                F.col("accounting_document").alias("document_id"),
                F.col("customer").alias("customer_id"),
                F.col("posting_date").alias("invoice_date"),
                "currency", "amount_lc", "profit_center",
                bucket100("company_code", "accounting_document", "fiscal_year").alias("item_bucket")))


def ap_base(journal: DataFrame) -> DataFrame:
    """Supplier credit lines, amounts made positive."""
    return (_ap_lines(journal)
            .select(
                "company_code", "fiscal_year",
                F.col("accounting_document").alias("document_id"),
                F.col("supplier").alias("supplier_id"),
                F.col("posting_date").alias("invoice_date"),
                "currency",
                F.abs("amount_lc").cast(MONEY).alias("amount_lc"),
                bucket100("company_code", "accounting_document", "fiscal_year", F.lit(AP_SALT))
                .alias("item_bucket")))


def _yield_usd(days) -> Column:
    """Amount in USD x APR x days / 365, rounded half up to cents.  All in
    whole numbers (cents, millionths) with one division, so nothing is lost
    to DOUBLE; of ``days`` >= 0."""
    cents = (F.col("amount_lc") * 100).cast("decimal(18,0)")
    rate = (F.col("rate_to_usd") * 1_000_000).cast("decimal(8,0)")
    apr = (F.col("dd_apr") * 1_000_000).cast("decimal(6,0)")
    year = F.lit(365 * 10 ** 12).cast("decimal(18,0)")
    n = (cents * rate).cast("decimal(26,0)") * apr
    n = n.cast("decimal(32,0)") * days.cast("decimal(5,0)")
    half_up = F.call_function("div", 2 * n + year, 2 * year)
    return (half_up.cast("decimal(18,0)") / 100).cast(MONEY)


def by_date(lines: DataFrame) -> DataFrame:
    """Journal lines dealt to tasks by ranges of posting dates, of equal numbers
    of lines: before any column is added to them they are a third as wide, and
    a task then writes few months.  The lines of a hot date are split by their
    documents."""
    return lines.repartitionByRange(_tasks(lines), "posting_date", F.xxhash64("accounting_document"))


def evenly(lines: DataFrame) -> DataFrame:
    """Journal lines dealt to tasks of equal numbers of lines, in no order: a
    journal's files hold uneven numbers of the lines of a side."""
    return lines.repartition(_tasks(lines), "accounting_document", "posting_date", "amount_lc")


def _to_tasks(lines: DataFrame, spread: bool, even: bool) -> DataFrame:
    return by_date(lines) if spread else evenly(lines) if even else lines


def _tasks(lines: DataFrame) -> int:
    rows = lines.count()
    return max(1, min(MANY_TASKS, -(-rows // FEW_ROWS)), -(-rows // MOST_ROWS))


def _partner_join(base: DataFrame, dim: DataFrame, key: str, split_hot: bool) -> DataFrame:
    # A streaming micro-batch joins the static dimension directly; a batch
    # build splits hot partners off (see operators.skew_join).  Lines without a
    # partner have been left out, so no key is null.
    return split_join(base, dim, key, keyed=True) if split_hot else base.join(dim, key)


def ar_core(journal: DataFrame, dim_customer: DataFrame, dim_company: DataFrame,
            split_hot: bool | None = None, spread: bool = False, even: bool = False) -> DataFrame:
    """``spread``: lines go to tasks ``by_date`` first; ``even``: ``evenly``."""
    h = F.col("item_bucket")
    base = ar_base(_to_tasks(_ar_lines(journal), spread, even))
    cust = dim_customer.select("customer_id", "customer_name", "segment", "credit_risk", "payment_terms",
                               "terms_days", "avg_delay_days")
    comp = F.broadcast(dim_company.select("company_code", "company", "rate_to_usd"))
    split = (not journal.isStreaming) if split_hot is None else split_hot
    return (_partner_join(base, cust, "customer_id", split).join(comp, "company_code")
            .select(
                "company_code", "company", "fiscal_year", "document_id", "customer_id", "customer_name",
                "segment", "credit_risk", "profit_center", "currency", "payment_terms", "terms_days",
                "invoice_date", month_str("invoice_date").alias("invoice_month"),
                F.date_add("invoice_date", F.col("terms_days")).alias("due_date"),
                F.date_add("invoice_date", F.col("terms_days") + F.col("avg_delay_days") + h % 9 - 4)
                .alias("expected_clearing_date"),
                "amount_lc",
                F.round(F.col("amount_lc") * F.col("rate_to_usd"), 2).cast(MONEY).alias("amount_usd"),
                "item_bucket"))


def ar_status(core: DataFrame, as_of: dt.date) -> DataFrame:
    a = F.lit(as_of)
    core = core.filter(F.col("invoice_date") <= a)
    exp, due, h = F.col("expected_clearing_date"), F.col("due_date"), F.col("item_bucket")
    cleared = exp <= a
    dpd = F.datediff(a, due)
    return (core.select(
        "*",
        F.when(cleared, exp).alias("clearing_date"),
        (~cleared).alias("is_open"),
        F.when(~cleared, F.greatest(dpd, F.lit(0))).alias("days_past_due"),
        F.when(cleared, F.datediff(exp, F.col("invoice_date"))).alias("days_to_pay"),
        F.when(cleared, exp <= due).alias("paid_on_time"),
        F.when(cleared, "Cleared").when(due >= a, "Not Due").when(dpd <= 30, "1-30").when(dpd <= 60, "31-60")
         .when(dpd <= 90, "61-90").otherwise("90+").alias("aging_bucket"),
        ((~cleared) & (h < 6)).alias("is_disputed"),
        F.when(cleared | (due >= a), 0).when(dpd <= 15, 1).when(dpd <= 45, 2).otherwise(3).alias("dunning_level"),
        ((~cleared) & (due < a) & (h % 4 == 0)).alias("has_promise_to_pay"),
    ).select(*AR_COLUMNS))


def ap_core(journal: DataFrame, dim_supplier: DataFrame, dim_company: DataFrame,
            split_hot: bool | None = None, spread: bool = False, even: bool = False) -> DataFrame:
    """``spread``: lines go to tasks ``by_date`` first; ``even``: ``evenly``."""
    h = F.col("item_bucket")
    base = ap_base(_to_tasks(_ap_lines(journal), spread, even))
    supp = dim_supplier.select("supplier_id", "supplier_name", "category", "supplier_segment", "early_pay_program",
                               "payment_terms", "terms_days", "static_discount_pct", "static_discount_days",
                               "dd_apr")
    comp = F.broadcast(dim_company.select("company_code", "company", "rate_to_usd"))
    prog = F.col("early_pay_program")
    pct = F.col("static_discount_pct")
    outcome = (F.when((prog == "Dynamic Discounting") & (h < 55), DD_ACCEPTED)
                .when((prog == "Supply Chain Finance") & (h < 70), SCF_FUNDED)
                .when((pct > 0) & (h < 40), STATIC_TAKEN)
                .when(pct > 0, STATIC_MISSED)
                .otherwise(AT_TERMS))
    split = (not journal.isStreaming) if split_hot is None else split_hot
    t = (_partner_join(base, supp, "supplier_id", split).join(comp, "company_code")
         .withColumn("payment_outcome", outcome)
         .withColumn("due_date", F.date_add("invoice_date", F.col("terms_days"))))
    po = F.col("payment_outcome")
    inv = F.col("invoice_date")
    expected = (F.when(po == DD_ACCEPTED, F.date_add(inv, 8 + h % 10))
                 .when(po == SCF_FUNDED, F.col("due_date"))
                 .when(po == STATIC_TAKEN, F.date_add(inv, F.col("static_discount_days")))
                 .otherwise(F.date_add(inv, F.col("terms_days") + F.when(h % 10 == 0, -7).otherwise(h % 9))))
    t = t.withColumn("expected_payment_date", expected)

    # Discount economics in USD, counted by invoice whether or not paid yet.
    usd_exact = F.col("amount_lc") * F.col("rate_to_usd")  # DECIMAL, exact
    dd_days = F.datediff(F.col("due_date"), F.col("expected_payment_date"))
    captured = (F.when(po == DD_ACCEPTED, _yield_usd(dd_days))
                 .when(po == STATIC_TAKEN, F.round(usd_exact * pct, 2).cast(MONEY))
                 .otherwise(F.lit(0).cast(MONEY)))
    lost = F.when(po == STATIC_MISSED, F.round(usd_exact * pct, 2)).otherwise(F.lit(0)).cast(MONEY)
    dd_opp = (F.when((prog == "Dynamic Discounting") & (po != DD_ACCEPTED),
                     _yield_usd(F.greatest(F.col("terms_days") - 12, F.lit(0))))
               .otherwise(F.lit(0).cast(MONEY)))
    scf = F.when(po == SCF_FUNDED, F.round(usd_exact, 2)).otherwise(F.lit(0)).cast(MONEY)
    return t.select(
        "company_code", "company", "fiscal_year", "document_id", "supplier_id", "supplier_name", "category",
        "supplier_segment", "early_pay_program", "payment_terms", "terms_days", "payment_outcome", "currency",
        "invoice_date", month_str("invoice_date").alias("invoice_month"), "due_date", "expected_payment_date",
        F.when(po == SCF_FUNDED, F.date_add(inv, 5 + h % 6)).alias("supplier_funded_date"),
        "amount_lc",
        F.round(usd_exact, 2).cast(MONEY).alias("amount_usd"),
        ((F.col("expected_payment_date") < F.col("due_date"))
         & ~po.isin(DD_ACCEPTED, STATIC_TAKEN, SCF_FUNDED)).alias("paid_early_no_benefit"),
        captured.alias("discount_captured_usd"),
        lost.alias("discount_lost_usd"),
        dd_opp.alias("dd_opportunity_usd"),
        scf.alias("scf_funded_usd"),
    )


def ap_status(core: DataFrame, as_of: dt.date) -> DataFrame:
    a = F.lit(as_of)
    core = core.filter(F.col("invoice_date") <= a)
    exp, due = F.col("expected_payment_date"), F.col("due_date")
    paid = exp <= a
    dpd = F.datediff(a, due)
    return (core.select(
        "*",
        F.when(paid, exp).alias("payment_date"),
        (~paid).alias("is_open"),
        F.when(~paid, F.greatest(dpd, F.lit(0))).alias("days_past_due"),
        F.when(paid, F.datediff(exp, F.col("invoice_date"))).alias("days_to_pay"),
        F.when(paid, exp <= due).alias("paid_on_time"),
        F.when(paid, "Paid").when(due >= a, "Not Due").when(dpd <= 30, "1-30").when(dpd <= 60, "31-60")
         .otherwise("60+").alias("aging_bucket"),
    ).select(*AP_COLUMNS))


def ap_outcome_parts(ap_items: DataFrame) -> DataFrame:
    """AP items rolled up by (program, outcome, open flag): at most 3 x 5 x 2
    rows of additive parts (counts, sums, and the sums behind the day
    averages), from which the all-period AP figures are re-aggregated."""
    dtp = F.col("days_to_pay")
    return ap_items.groupBy("early_pay_program", "payment_outcome", "is_open").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_usd").alias("amount"),
        F.sum("discount_captured_usd").alias("captured"), F.sum("discount_lost_usd").alias("lost"),
        F.count(dtp).alias("n_dtp"), F.sum(dtp).alias("dtp_sum"),
        F.sum(F.when(dtp.isNotNull(), F.greatest(F.lit(1), dtp))).alias("dtp1_sum"),
        F.sum(F.when(F.col("paid_on_time"), 1).otherwise(0)).alias("on_time_n"))


def ar_status_parts(ar_items: DataFrame) -> DataFrame:
    """AR items rolled up by (segment, aging bucket, dunning level, open
    flag): at most 3 x 6 x 4 x 2 rows of additive parts, from which the
    company-wide AR aging, segment, dunning and behaviour figures are
    re-aggregated."""
    dtp = F.col("days_to_pay")
    return ar_items.groupBy("segment", "aging_bucket", F.coalesce("dunning_level", F.lit(0)).alias("level"),
                            "is_open").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_usd").alias("amount"),
        F.sum(F.when(F.col("days_past_due") > 0, F.col("amount_usd")).otherwise(F.lit(0))).alias("overdue"),
        F.count(dtp).alias("n_dtp"), F.sum(dtp).alias("dtp_sum"),
        F.sum(F.when(F.col("paid_on_time"), 1).otherwise(0)).alias("on_time_n"))
