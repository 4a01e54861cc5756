"""Fact packs: the figures a written analysis may quote, each with provenance.

Every fact is a small DataFrame built from the curated tables.  A pack
unions them into one long frame ``(topic, fact_key, provenance, row_json)``
with ``to_json(struct(*))`` per row, so the whole pack is produced by Spark
in one plan and never assembled on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerlens.functions.filters import Filter
from ledgerlens.functions.measures import safe_ratio, sum_if, weighted_ratio, sorted_small
from ledgerlens.plans import dashboard as D
from ledgerlens.plans.lineage import lineage_counts


def _all(wh) -> Filter:
    """Company-wide, default period."""
    p = wh.params
    return Filter((), p.period_from, p.period_to)


def _overdue():
    return sum_if(F.col("days_past_due") > 0, "amount_usd")


def _on_time_pct():
    return F.round(F.lit(100) * F.avg(F.when(F.col("paid_on_time"), 1).otherwise(0)), 1)


# ------------------------------------------------ shared / topic facts
def ask_kpi_by_company(wh) -> DataFrame:
    k = wh.wc_monthly_kpi.filter(F.col("month") == wh.params.latest_month)
    return k.select("company", "region", "dso", "dpo", "dio", "ccc",
                    F.col("net_working_capital_usd").alias("nwc")).transform(sorted_small("company"))


def ask_kpi_trend(wh) -> DataFrame:
    return (wh.wc_monthly_kpi.groupBy("month")
            .agg(weighted_ratio("dso", "revenue_usd").alias("dso"), weighted_ratio("dpo", "purchases_usd").alias("dpo"),
                 weighted_ratio("dio", "cogs_usd").alias("dio"), F.sum("net_working_capital_usd").alias("nwc"),
                 F.sum("ar_balance_usd").alias("ar"), F.sum("ap_balance_usd").alias("ap"),
                 F.sum("inventory_usd").alias("inventory"))
            .transform(sorted_small("month")))


def ask_ar_totals(wh) -> DataFrame:
    return wh.ar_items.filter("is_open").agg(
        F.sum("amount_usd").alias("open_ar"), _overdue().alias("overdue_ar"), F.count(F.lit(1)).alias("items"),
        F.countDistinct("customer_id").alias("customers"))


def ask_ap_totals(wh) -> DataFrame:
    return wh.ap_items.filter("is_open").agg(
        F.sum("amount_usd").alias("open_ap"), _overdue().alias("overdue_ap"), F.count(F.lit(1)).alias("items"),
        F.countDistinct("supplier_id").alias("suppliers"))


def ask_levers(wh) -> DataFrame:
    return D.opp_by_lever(wh, _all(wh)).withColumnRenamed("name", "lever")


def ask_cash_now(wh) -> DataFrame:
    """Latest-week bank balance by company (global latest week)."""
    bank = wh.bank_balance_weekly
    latest = bank.agg(F.max("week_end").alias("latest_week"))
    return (bank.join(F.broadcast(latest), F.col("week_end") == F.col("latest_week"))
                .groupBy("company").agg(F.sum("balance_usd").alias("balance"))
                .transform(sorted_small(F.desc("balance"), "company")))


def ask_weekly_26(wh) -> DataFrame:
    """Total bank balance of the last 26 weeks, newest first."""
    return (wh.bank_balance_weekly.groupBy(F.date_format("week_end", "yyyy-MM-dd").alias("week"))
            .agg(F.sum("balance_usd").alias("balance")).orderBy(F.desc("week")).limit(26))


def ask_forecast_rows(wh) -> DataFrame:
    """Raw forecast rows by week number."""
    return wh.cash_forecast.orderBy("week_no", "company_code")


# The company-wide AR behaviour, aging, segment and dunning facts
# re-aggregate the warehouse's ``ar_parts`` rollup (items.ar_status_parts).
def ask_ar_behaviour(wh) -> DataFrame:
    return wh.ar_parts.filter(~F.col("is_open")).agg(
        F.round(F.lit(100) * _mean("on_time_n", "n"), 1).alias("on_time_pct"),
        F.round(_mean("dtp_sum", "n_dtp"), 1).alias("avg_days_to_pay"))


def ask_ar_aging(wh) -> DataFrame:
    return (wh.ar_parts.filter("is_open").groupBy("aging_bucket")
            .agg(F.sum("amount").alias("amount"), F.sum("n").alias("items")).transform(sorted_small("aging_bucket")))


def ask_top10_overdue(wh) -> DataFrame:
    fine = wh.ar_items.filter("is_open").groupBy("customer_name", "segment", "credit_risk").agg(
        _overdue().alias("overdue"), F.max("days_past_due").alias("max_dpd"))
    g = fine.groupBy("customer_name").agg(
        F.max("segment").alias("segment"), F.max("credit_risk").alias("risk"), F.sum("overdue").alias("overdue"),
        F.max("max_dpd").alias("max_dpd"))
    return g.filter(F.col("overdue") > 0).orderBy(F.desc("overdue"), "customer_name").limit(10)


def ask_ar_by_segment(wh) -> DataFrame:
    return (wh.ar_parts.filter("is_open").groupBy("segment")
            .agg(F.sum("amount").alias("open_ar"), F.sum("overdue").alias("overdue"))
            .transform(sorted_small(F.desc("open_ar"), "segment")))


def ask_ar_dunning(wh) -> DataFrame:
    return (wh.ar_parts.filter("is_open").groupBy("level")
            .agg(F.sum("n").alias("items"), F.sum("amount").alias("amount")).transform(sorted_small("level")))


def ask_dso_trend(wh) -> DataFrame:
    return (wh.wc_monthly_kpi.groupBy("month")
            .agg(weighted_ratio("dso", "revenue_usd").alias("dso"), F.sum("ar_overdue_usd").alias("overdue"))
            .transform(sorted_small("month")))


def ap_parts(wh) -> DataFrame:
    """The all-period AP facts re-aggregate the warehouse's ``ap_parts``
    rollup (see ``items.ap_outcome_parts``) instead of scanning the AP
    items each."""
    return wh.ap_parts


def _mean(total: str, count: str):
    # AVG of an integer column: its sum as DOUBLE over the row count
    n = F.sum(count).cast("double")
    return F.sum(total).cast("double") / F.when(n != 0, n)


def ask_ap_behaviour(wh) -> DataFrame:
    """Payment behaviour over all periods (not only the default period)."""
    return ap_parts(wh).filter(~F.col("is_open")).agg(
        F.round(_mean("dtp_sum", "n_dtp"), 1).alias("avg_days_to_pay"),
        F.round(F.lit(100) * _mean("on_time_n", "n"), 1).alias("on_time_pct"),
        F.sum("captured").alias("discount_captured"), F.sum("lost").alias("discount_lost"))


def ask_ap_aging(wh) -> DataFrame:
    return (wh.ap_items.filter("is_open").groupBy("aging_bucket")
            .agg(F.sum("amount_usd").alias("amount"), F.count(F.lit(1)).alias("items")).transform(sorted_small("aging_bucket")))


def ask_top_suppliers(wh) -> DataFrame:
    fine = wh.ap_items.filter("is_open").groupBy("supplier_name", "category").agg(
        F.sum("amount_usd").alias("open_ap"), _overdue().alias("overdue"))
    g = fine.groupBy("supplier_name").agg(
        F.max("category").alias("category"), F.sum("open_ap").alias("open_ap"), F.sum("overdue").alias("overdue"))
    return g.orderBy(F.desc("open_ap"), "supplier_name").limit(10)


def ask_dpo_trend(wh) -> DataFrame:
    return (wh.wc_monthly_kpi.groupBy("month")
            .agg(weighted_ratio("dpo", "purchases_usd").alias("dpo"), F.sum("ap_balance_usd").alias("ap"))
            .transform(sorted_small("month")))


def ask_ep_totals(wh) -> DataFrame:
    return ap_parts(wh).agg(F.sum("amount").alias("volume"), F.sum("captured").alias("discount_captured"),
                            F.sum("lost").alias("discount_lost"))


def ask_ep_by_program(wh) -> DataFrame:
    return (wh.ap_items.groupBy("early_pay_program")
            .agg(F.sum("amount_usd").alias("volume"), F.countDistinct("supplier_id").alias("suppliers"),
                 F.sum("discount_captured_usd").alias("captured"))
            .transform(sorted_small(F.desc("volume"), "early_pay_program")))


def ask_ep_by_outcome(wh) -> DataFrame:
    return (ap_parts(wh).groupBy("payment_outcome")
            .agg(F.sum("n").alias("items"), F.sum("amount").alias("volume"), F.sum("captured").alias("captured"))
            .transform(sorted_small(F.desc("volume"), "payment_outcome")))


def ask_dd_yield(wh) -> DataFrame:
    """DD yield with AVG(GREATEST(1, days_to_pay)) as the day basis."""
    dd = ap_parts(wh).filter(F.col("payment_outcome") == "DD Accepted")
    basis = _mean("dtp1_sum", "n_dtp")
    cap = F.sum("captured").cast("double")
    amt = F.sum("amount").cast("double")
    y = F.lit(100.0) * cap / F.when(amt != 0, amt) * F.lit(365.0) / F.when(basis != 0, basis)
    return dd.agg(F.round(y, 2).alias("yield_pct"))


def ask_inv_dio_trend(wh) -> DataFrame:
    return (wh.wc_monthly_kpi.groupBy("month")
            .agg(weighted_ratio("dio", "cogs_usd").alias("dio"), F.sum("inventory_usd").alias("inventory"))
            .transform(sorted_small("month")))


def ask_inv_categories(wh) -> DataFrame:
    f = Filter((), wh.params.period_from, wh.params.latest_month)
    return D.inv_categories(wh, f).drop("gap_days").withColumnRenamed("name", "inventory_category")


def ask_opp_by_company(wh) -> DataFrame:
    return D.opp_by_company(wh, _all(wh)).withColumnRenamed("name", "company")


def ask_top_levers(wh) -> DataFrame:
    return (wh.wc_opportunities.select("company", "lever", "area", "current_days", "target_days",
                                       "cash_release_usd", "pnl_impact_usd")
            .orderBy(F.desc("cash_release_usd"), "company", "lever").limit(15))


TOPICS = {
    "general": ["ask_kpi_by_company", "ask_kpi_trend", "ask_ar_totals", "ask_ap_totals", "ask_cash_now",
                "ask_levers"],
    "overview": ["ask_kpi_by_company", "ask_kpi_trend"],
    "cash": ["ask_cash_now", "cash_by_bank", "cash_by_purpose", "ask_weekly_26", "ask_forecast_rows"],
    "ar": ["ask_ar_totals", "ask_ar_behaviour", "ask_ar_aging", "ask_top10_overdue", "ask_ar_by_segment",
           "ask_ar_dunning", "ask_dso_trend"],
    "ap": ["ask_ap_totals", "ask_ap_behaviour", "ask_ap_aging", "ask_top_suppliers", "ask_dpo_trend"],
    "early-pay": ["ask_ep_totals", "ask_ep_by_program", "ask_ep_by_outcome", "ask_dd_yield"],
    "inventory": ["ask_inv_dio_trend", "ask_inv_categories"],
    "opportunities": ["ask_levers", "ask_opp_by_company", "ask_top_levers"],
}


def _fact(wh, key: str) -> DataFrame:
    if key in ("cash_by_bank", "cash_by_purpose"):
        return getattr(D, key)(wh, _all(wh))
    return globals()[key](wh)


PROVENANCE = {
    "ask_kpi_by_company": "wc_monthly_kpi, latest month",
    "ask_kpi_trend": "wc_monthly_kpi, all months, weighted DSO/REVENUE, DPO/PURCHASES, DIO/COGS",
    "ask_ar_totals": "ar_items, open", "ask_ap_totals": "ap_items, open",
    "ask_cash_now": "bank_balance_weekly, latest week", "ask_levers": "wc_opportunities by lever",
    "cash_by_bank": "bank_balance_weekly, latest week, by house bank",
    "cash_by_purpose": "bank_balance_weekly, latest week, by purpose",
    "ask_weekly_26": "bank_balance_weekly, last 26 weeks", "ask_forecast_rows": "cash_forecast rows",
    "ask_ar_behaviour": "ar_items, cleared", "ask_ar_aging": "ar_items, open by aging bucket",
    "ask_top10_overdue": "ar_items, open, top 10 customers by overdue", "ask_ar_by_segment": "ar_items, open by segment",
    "ask_ar_dunning": "ar_items, open by dunning level", "ask_dso_trend": "wc_monthly_kpi, weighted DSO by month",
    "ask_ap_behaviour": "ap_items, paid, all periods", "ask_ap_aging": "ap_items, open by aging bucket",
    "ask_top_suppliers": "ap_items, open, top 10 suppliers", "ask_dpo_trend": "wc_monthly_kpi, weighted DPO by month",
    "ask_ep_totals": "ap_items", "ask_ep_by_program": "ap_items by program", "ask_ep_by_outcome": "ap_items by outcome",
    "ask_dd_yield": "ap_items, DD Accepted, captured/amount*365/avg(greatest(1, days_to_pay))",
    "ask_inv_dio_trend": "wc_monthly_kpi, weighted DIO by month",
    "ask_inv_categories": "inventory_monthly x dim_inventory_category, latest month",
    "ask_opp_by_company": "wc_opportunities by company", "ask_top_levers": "wc_opportunities, top 15",
}


def fact_pack(wh, topics: list[str] | None = None) -> DataFrame:
    """All facts of the given topics as ``(topic, fact_key, provenance, row_json)``.

    Each distinct fact is computed once (several topics share facts); the
    union of those small aggregates is fanned out to its topics by a join
    with the literal topic list."""
    topics = topics or list(TOPICS)
    pairs = [(t, k) for t in topics for k in TOPICS[t]]
    keys = list(dict.fromkeys(k for _, k in pairs))
    parts = []
    for key in keys:
        df = _fact(wh, key)
        parts.append(df.select(F.lit(key).alias("fact_key"), F.lit(PROVENANCE[key]).alias("provenance"),
                               F.to_json(F.struct(*df.columns)).alias("row_json")))
    topic_map = wh.spark.createDataFrame(pairs, "topic string, fact_key string")
    return (reduce(DataFrame.unionByName, parts).join(F.broadcast(topic_map), "fact_key")
            .select("topic", "fact_key", "provenance", "row_json"))


# ------------------------------------------------ report facts
def fact_kpi_by_company(wh, month: str | None = None) -> DataFrame:
    m = month or wh.params.latest_month
    return (wh.wc_monthly_kpi.filter(F.col("month") == m)
            .select("company_code", "company", "region", "dso", "dpo", "dio", "ccc", "ar_balance_usd",
                    "ar_overdue_usd", F.round(F.col("ar_overdue_pct") * 100, 1).alias("ar_overdue_pct"),
                    "ap_balance_usd", "inventory_usd", "net_working_capital_usd", "discount_captured_usd",
                    "discount_lost_usd")
            .transform(sorted_small("company_code")))


def fact_kpi_total(wh) -> DataFrame:
    """Weighted totals for the latest month and the same month a year
    before, with CCC from the rounded parts and the change in CCC."""
    p = wh.params
    k = wh.wc_monthly_kpi.filter(F.col("month").isin(p.latest_month, p.prior_month))
    g = k.groupBy("month").agg(
        weighted_ratio("dso", "revenue_usd").alias("dso"), weighted_ratio("dpo", "purchases_usd").alias("dpo"),
        weighted_ratio("dio", "cogs_usd").alias("dio"), F.sum("ar_balance_usd").alias("ar_balance_usd"),
        F.sum("ar_overdue_usd").alias("ar_overdue_usd"), F.sum("ap_balance_usd").alias("ap_balance_usd"),
        F.sum("inventory_usd").alias("inventory_usd"), F.sum("net_working_capital_usd").alias("nwc_usd"),
        F.sum("revenue_usd").alias("revenue_usd"), F.sum("discount_captured_usd").alias("disc_captured_usd"),
        F.sum("discount_lost_usd").alias("disc_lost_usd"))
    g = g.withColumn("ccc", F.round(F.col("dso") + F.col("dio") - F.col("dpo"), 1))
    one = Window.partitionBy(F.lit(1))
    lat = F.max(F.when(F.col("month") == p.latest_month, F.col("ccc"))).over(one)
    pri = F.max(F.when(F.col("month") == p.prior_month, F.col("ccc"))).over(one)
    return g.withColumn("ccc_change_days", F.round(lat - pri, 1)).transform(sorted_small("month"))


def fact_window(wh) -> DataFrame:
    return wh.wc_monthly_kpi.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"),
                                 F.countDistinct("month").alias("months"))


def fact_ar_open(wh) -> DataFrame:
    return wh.ar_items.filter("is_open").agg(
        F.count(F.lit(1)).alias("open_items"), F.sum("amount_usd").alias("open_ar_usd"),
        _overdue().alias("overdue_usd"),
        F.round(safe_ratio(F.lit(100.0) * _overdue().cast("double"), F.sum("amount_usd")), 1).alias("overdue_pct"),
        sum_if(F.col("is_disputed"), "amount_usd").alias("disputed_usd"))


def fact_ar_all(wh) -> DataFrame:
    return wh.ar_items.filter(~F.col("is_open")).agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("customer_id").alias("customers"),
        _on_time_pct().alias("on_time_pct"))


def fact_ar_aging(wh) -> DataFrame:
    return (wh.ar_items.filter("is_open").groupBy("aging_bucket")
            .agg(F.count(F.lit(1)).alias("items"), F.sum("amount_usd").alias("usd"))
            .transform(sorted_small(F.desc("usd"), "aging_bucket")))


def fact_top5_overdue(wh) -> DataFrame:
    """Top five overdue customers by (name, credit risk)."""
    g = (wh.ar_items.filter(F.col("is_open") & (F.col("days_past_due") > 0))
         .groupBy("customer_name", "credit_risk")
         .agg(F.count(F.lit(1)).alias("items"), F.sum("amount_usd").alias("overdue_usd"),
              F.max("days_past_due").alias("max_dpd")))
    return g.orderBy(F.desc("overdue_usd"), "customer_name", "credit_risk").limit(5)


def fact_ap_open(wh) -> DataFrame:
    return wh.ap_items.filter("is_open").agg(F.count(F.lit(1)).alias("open_items"),
                                             F.sum("amount_usd").alias("open_ap_usd"))


def fact_ap_all(wh) -> DataFrame:
    ap = wh.ap_items.filter(~F.col("is_open"))
    enb = sum_if(F.col("paid_early_no_benefit"), "amount_usd")
    return ap.agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("supplier_id").alias("suppliers"),
        F.sum("amount_usd").alias("paid_usd"), _on_time_pct().alias("on_time_pct"),
        F.sum("discount_captured_usd").alias("disc_captured_usd"), F.sum("discount_lost_usd").alias("disc_lost_usd"),
        F.sum("scf_funded_usd").alias("scf_funded_usd"), F.sum("dd_opportunity_usd").alias("dd_opportunity_usd"),
        F.round(safe_ratio(F.lit(100.0) * enb.cast("double"), F.sum("amount_usd")), 1).alias("early_no_benefit_pct"))


def fact_ap_latest_month(wh) -> DataFrame:
    ap = wh.ap_items.filter(F.col("invoice_month") == wh.params.latest_month)
    return ap.agg(F.sum("discount_captured_usd").alias("disc_captured_usd"),
                  F.sum("discount_lost_usd").alias("disc_lost_usd"), F.sum("scf_funded_usd").alias("scf_funded_usd"),
                  F.sum("dd_opportunity_usd").alias("dd_opportunity_usd"))


def fact_ap_by_program(wh) -> DataFrame:
    return (wh.ap_items.groupBy("early_pay_program")
            .agg(F.count(F.lit(1)).alias("items"), F.sum("amount_usd").alias("usd"),
                 F.sum("discount_captured_usd").alias("captured_usd"), F.sum("discount_lost_usd").alias("lost_usd"),
                 F.sum("scf_funded_usd").alias("scf_usd"), F.sum("dd_opportunity_usd").alias("dd_opp_usd"))
            .transform(sorted_small(F.desc("usd"), "early_pay_program")))


def fact_dd_apr(wh) -> DataFrame:
    """Amount-weighted DD APR: captured / (amount x days accelerated / 365)."""
    dd = wh.ap_items.filter(F.col("payment_outcome") == "DD Accepted")
    dtp = F.col("days_to_pay")
    accel = F.when(dtp.isNotNull(), F.greatest(F.col("terms_days") - dtp, F.lit(1)))
    basis = F.sum(F.col("amount_usd").cast("double") * accel / F.lit(365.0))
    cap = F.sum("discount_captured_usd").cast("double")
    return dd.agg(F.round(F.lit(100.0) * cap / F.when(basis != 0, basis), 1).alias("apr_pct"))


def fact_inventory_by_category(wh) -> DataFrame:
    i = wh.inventory_monthly.filter(F.col("month") == wh.params.latest_month)
    c = F.broadcast(wh.dim_inventory_category.select("inventory_category", "target_dio"))
    return (i.join(c, "inventory_category").groupBy("inventory_category")
            .agg(F.sum("inventory_value_usd").alias("value_usd"),
                 F.round(safe_ratio(F.sum("inventory_value_usd"), F.sum("cogs_usd")) * F.lit(365.0) / F.lit(12.0), 1)
                 .alias("dio"), F.max("target_dio").alias("target_dio"))
            .transform(sorted_small(F.desc("value_usd"), "inventory_category")))


def fact_cash_13w(wh) -> DataFrame:
    fc = wh.cash_forecast
    return (fc.groupBy("company")
            .agg(F.sum("ar_receipts_usd").alias("receipts_usd"),
                 F.sum(F.col("ap_payments_usd") + F.col("payroll_usd") + F.col("other_opex_usd")).alias("outflows_usd"),
                 F.sum(F.col("ar_receipts_usd") - F.col("ap_payments_usd") - F.col("payroll_usd")
                       - F.col("other_opex_usd")).alias("net_usd"),
                 F.min("week_end").alias("first_week"), F.max("week_end").alias("last_week"),
                 F.countDistinct("week_no").alias("weeks"))
            .transform(sorted_small("company")))


def fact_release_by_lever(wh) -> DataFrame:
    return (wh.wc_opportunities.groupBy("lever", "area")
            .agg(F.sum("cash_release_usd").alias("cash_release_usd"), F.sum("pnl_impact_usd").alias("pnl_impact_usd"))
            .transform(sorted_small(F.desc("cash_release_usd"), "lever")))


def argmax_company(wh) -> DataFrame:
    """Company with the highest DIO and with the highest CCC, latest month
    (ties go to the lowest company code)."""
    k = fact_kpi_by_company(wh).select("company_code", "company", "dio", "ccc")
    parts = []
    for fact, col in (("highest_dio_company", "dio"), ("highest_ccc_company", "ccc")):
        w = Window.orderBy(F.col(col).desc_nulls_last(), "company_code")
        parts.append(k.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
                      .select(F.lit(fact).alias("fact"), "company_code", "company", "dio", "ccc"))
    return parts[0].unionByName(parts[1])


# ------------------------------------------------ report pack
# fact -> (columns that name a row, provenance)
REPORT = {
    "kpi_by_company_latest": (["company_code"], "wc_monthly_kpi, latest month"),
    "kpi_by_company_prior": (["company_code"], "wc_monthly_kpi, same month a year before"),
    "kpi_total": (["month"], "wc_monthly_kpi, weighted DSO/REVENUE, DPO/PURCHASES, DIO/COGS"),
    "highest_company": (["fact"], "greatest DIO and CCC in the latest month"),
    "window": ([], "wc_monthly_kpi"),
    "ar_open": ([], "ar_items, open"),
    "ar_all": ([], "ar_items, cleared"),
    "ar_aging": (["aging_bucket"], "ar_items, open by aging bucket"),
    "top_overdue_customers": (["customer_name", "credit_risk"], "ar_items, open overdue by customer"),
    "ap_open": ([], "ap_items, open"),
    "ap_all": ([], "ap_items, paid, full window"),
    "ap_latest_month": ([], "ap_items, invoiced in the latest month"),
    "ap_by_program": (["early_pay_program"], "ap_items by program, full window"),
    "dd_effective_apr": ([], "ap_items, DD Accepted: captured / (amount x days accelerated / 365)"),
    "inventory_by_category": (["inventory_category"], "inventory_monthly x dim_inventory_category, latest month"),
    "cash_13w_by_company": (["company"], "cash_forecast, receipts - AP - payroll - opex"),
    "cash_13w_net_usd": ([], "sum of cash_13w_by_company"),
    "cash_release_by_lever": (["lever"], "wc_opportunities"),
    "cash_release_total": ([], "sum of cash_release_by_lever"),
    "opportunities": (["company", "lever"], "wc_opportunities"),
    "lineage_counts": ([], "row counts of sources and item tables"),
}


def _report_fact(wh, fact: str) -> DataFrame:
    if fact == "kpi_by_company_prior":
        return fact_kpi_by_company(wh, wh.params.prior_month).select("company_code", "company", "dso", "dpo", "dio", "ccc")
    if fact == "cash_13w_net_usd":
        return fact_cash_13w(wh).agg(F.sum("net_usd").alias("net_usd"))
    if fact == "cash_release_total":
        return fact_release_by_lever(wh).agg(*[F.sum(c).alias(c) for c in ("cash_release_usd", "pnl_impact_usd")])
    if fact == "opportunities":
        return D.opp_rows(wh, _all(wh))
    return {"kpi_by_company_latest": fact_kpi_by_company, "kpi_total": fact_kpi_total, "highest_company": argmax_company,
            "window": fact_window, "ar_open": fact_ar_open, "ar_all": fact_ar_all, "ar_aging": fact_ar_aging,
            "top_overdue_customers": fact_top5_overdue, "ap_open": fact_ap_open, "ap_all": fact_ap_all,
            "ap_latest_month": fact_ap_latest_month, "ap_by_program": fact_ap_by_program, "dd_effective_apr": fact_dd_apr,
            "inventory_by_category": fact_inventory_by_category, "cash_13w_by_company": fact_cash_13w,
            "cash_release_by_lever": fact_release_by_lever, "lineage_counts": lineage_counts}[fact](wh)


def report_pack(wh) -> DataFrame:
    """All facts of the written report with their provenance, one row a value:
    ``(fact, provenance, row_name, measure, value, label)``.  Numbers are
    ``value``; texts and dates are ``label``."""
    parts = []
    for fact, (names, provenance) in REPORT.items():
        df = _report_fact(wh, fact)
        cells = []
        for f in df.schema.fields:
            if f.name in names:
                continue
            number = isinstance(f.dataType, NumericType)
            cells.append(F.struct(F.lit(f.name).alias("measure"),
                                  (F.col(f.name) if number else F.lit(None)).cast("double").alias("value"),
                                  (F.lit(None) if number else F.col(f.name)).cast("string").alias("label")))
        parts.append(df.select(F.lit(fact).alias("fact"), F.lit(provenance).alias("provenance"),
                               F.concat_ws(" ", F.lit("") if not names else names[0], *names[1:]).alias("row_name"),
                               F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)
