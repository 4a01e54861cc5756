"""Company-subset snapshots of the dashboard cards.

The dashboard can be filtered to any subset of companies (the empty subset
meaning all).  Rather than running every page once per subset, each measure is
computed once per company as additive parts (sums, counts, numerator and
denominator of every ratio), which ``operators.lattice`` adds up for every
subset.  Exact distinct counts do not add across companies; they come from
united bitmaps.  The item tables are read through the rollups that
``plans.pages`` stores.  ``write_snapshot`` writes the whole page documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.filters import Filter
from ledgerlens.functions.measures import safe_ratio, sorted_small, sum_if
from ledgerlens.operators.lattice import company_names, of_subset, subset_totals, subsets
from ledgerlens.plans.pages import page_documents, pages


def subset_members(wh, month_from: str, month_to: str) -> DataFrame:
    """(subset_key, companies, company) for every subset of the companies; the
    key is the sorted company names joined by ',' plus '||from..to'."""
    names = company_names(wh.dim_company)
    member = wh.dim_company.select("company").distinct().withColumn("mask", F.explode(of_subset(names)))
    key = F.concat("companies", F.lit(f"||{month_from}..{month_to}"))
    return subsets(wh.spark, names).join(member, "mask").select(key.alias("subset_key"), "companies", "company")


def _per_company(wh, flt: Filter) -> DataFrame:
    """Additive parts of every card, one row per company."""
    m_to = flt.month_to
    k = wh.wc_monthly_kpi.filter(F.col("month") == m_to)
    kpi = k.groupBy("company").agg(
        F.sum(F.col("dso") * F.col("revenue_usd").cast("double")).alias("dso_num"),
        F.sum(F.col("revenue_usd").cast("double")).alias("dso_den"),
        F.sum(F.col("dpo") * F.col("purchases_usd").cast("double")).alias("dpo_num"),
        F.sum(F.col("purchases_usd").cast("double")).alias("dpo_den"),
        F.sum(F.col("dio") * F.col("cogs_usd").cast("double")).alias("dio_num"),
        F.sum(F.col("cogs_usd").cast("double")).alias("dio_den"),
        F.sum("net_working_capital_usd").alias("nwc"), F.sum("ar_balance_usd").alias("ar"),
        F.sum("ap_balance_usd").alias("ap"), F.sum("inventory_usd").alias("inventory"))
    p = pages(wh, flt)
    ar_open = p.ar_open.groupBy("company").agg(
        F.sum("amount").alias("open_ar"), F.sum("overdue").alias("overdue_ar"), F.sum("disputed").alias("disputed"),
        F.sum("promised").alias("promised"), F.sum("items").alias("ar_open_items"))
    ar_paid = (wh.ar_items.filter(flt.month_pred("invoice_month") & ~F.col("is_open")).groupBy("company")
               .agg(F.sum(F.when(F.col("paid_on_time"), 1).otherwise(0)).alias("ar_on_time_n"),
                    F.count(F.lit(1)).alias("ar_paid_n"), F.sum("days_to_pay").alias("ar_days_sum")))
    ap_open = p.ap_open.groupBy("company").agg(
        F.sum("amount").alias("open_ap"), F.sum("overdue").alias("overdue_ap"), F.sum("items").alias("ap_open_items"))
    ap_per = p.ap_period.groupBy("company").agg(
        F.sum("amount").alias("ap_volume"), F.sum("captured").alias("discount_captured"),
        F.sum("lost").alias("discount_lost"), F.sum("dd_opportunity").alias("dd_opportunity"),
        F.sum("scf_funded").alias("scf_funded"),
        sum_if(F.col("early_pay_program") == "Standard", "amount").alias("standard_volume"))
    inv = (wh.inventory_monthly.filter(F.col("month") == m_to).groupBy("company")
           .agg(F.sum("inventory_value_usd").alias("inv_value"),
                F.sum(F.col("inventory_value_usd") * F.col("slow_moving_pct")).alias("slow_moving")))
    opp = wh.wc_opportunities.groupBy("company").agg(F.sum("cash_release_usd").alias("cash_release"),
                                                     F.sum("pnl_impact_usd").alias("pnl_impact"))
    fc = wh.cash_forecast.groupBy("company").agg(
        F.sum(F.col("ar_receipts_usd") - F.col("ap_payments_usd") - F.col("payroll_usd") - F.col("other_opex_usd"))
        .alias("forecast_net"))
    parts = [kpi, ar_open, ar_paid, ap_open, ap_per, inv, opp, fc]
    return reduce(lambda a, b: a.join(b, "company", "full"), parts)


def snapshot_subsets(wh, flt: Filter | None = None) -> DataFrame:
    """One row per company subset with the cards of all pages."""
    p = wh.params
    flt = flt or Filter((), p.period_from, p.period_to)
    shared, per = pages(wh, flt), _per_company(wh, flt)
    names = shared.names
    agg = subset_totals(per, names, [], [c for c in per.columns if c != "company"])
    is_open = F.col("is_open")
    out = (agg.join(shared.partners("ar", is_open, "customers"), "mask", "left")
           .join(shared.partners("ap", is_open, "suppliers"), "mask", "left")
           .join(subsets(wh.spark, names), "mask", "right")
           .withColumn("subset_key", F.concat("companies", F.lit(f"||{flt.month_from}..{flt.month_to}"))))
    dso = F.round(safe_ratio("dso_num", "dso_den"), 1)
    dpo = F.round(safe_ratio("dpo_num", "dpo_den"), 1)
    dio = F.round(safe_ratio("dio_num", "dio_den"), 1)
    return out.select(
        "subset_key", "companies",
        F.round(dso + dio - dpo, 1).alias("ccc"), dso.alias("dso"), dpo.alias("dpo"), dio.alias("dio"),
        "nwc", "ar", "ap", "inventory",
        "open_ar", "overdue_ar",
        F.round(safe_ratio(F.lit(100.0) * F.col("overdue_ar").cast("double"), "open_ar"), 1).alias("overdue_pct"),
        "disputed", "promised", F.coalesce("ar_open_items", F.lit(0)).alias("ar_open_items"),
        F.coalesce("customers", F.lit(0)).alias("customers"),
        F.round(F.lit(100.0) * safe_ratio("ar_on_time_n", "ar_paid_n"), 1).alias("ar_on_time_pct"),
        F.round(safe_ratio("ar_days_sum", "ar_paid_n"), 1).alias("ar_avg_days_to_pay"),
        "open_ap", "overdue_ap", F.coalesce("ap_open_items", F.lit(0)).alias("ap_open_items"),
        F.coalesce("suppliers", F.lit(0)).alias("suppliers"),
        "ap_volume", "discount_captured", "discount_lost", "dd_opportunity", "scf_funded", "standard_volume",
        F.col("inv_value").alias("inventory_value"), "slow_moving",
        "cash_release", "pnl_impact", "forecast_net",
    ).transform(sorted_small("subset_key"))


def write_snapshot(wh, path: str, flt: Filter | None = None) -> DataFrame:
    """Write the page documents as JSON, one folder per page, keyed by subset;
    from one stored frame.  Returns what was written."""
    documents = page_documents(wh, flt)
    documents.write.mode("overwrite").partitionBy("page").json(path)
    return documents
