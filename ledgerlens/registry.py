"""Registered queries: key -> f(spark, sf_dir) -> DataFrame.

Every query runs over the whole test tables through the curated pipeline
(``Warehouse``), built once per session and data folder.  Outputs carry
DECIMAL money as DOUBLE so results compare across engines.

Not registered (they read only literal tables of this file's model, not the
data): ``dim_company``, ``dim_inventory_category``, ``dim_bank_account``,
``gen_weeks`` (``cash.weeks``), ``bank_balance_weekly``, ``cash_total``, ``cash_trend``, ``cash_trend_pivot``,
``cash_by_bank``, ``cash_by_purpose``, ``ask_cash_now``, ``ask_weekly_26``.
They are library functions, covered by the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.config import EARLY_AS_OF, TEST_PARAMS
from ledgerlens.functions.filters import Filter
from ledgerlens.functions.measures import sorted_small
from ledgerlens.plans import dashboard as D
from ledgerlens.plans import facts as FA
from ledgerlens.plans import flows as FL
from ledgerlens.plans import items as IT
from ledgerlens.plans import kpi as KP
from ledgerlens.plans import lineage as LI
from ledgerlens.plans import pages as PG
from ledgerlens.plans import snapshot as SN
from ledgerlens.plans import state_calendar as ST
from ledgerlens.plans.metrics import METRICS, metric_query
from ledgerlens.plans.warehouse import get_warehouse

P = TEST_PARAMS
DEFAULT = Filter((), P.period_from, P.period_to)
# A subset + reversed period + malformed month exercise the filter builder.
SUBSET = Filter.build("Japan Operations, US Operations", "2001-03", "2000-11",
                      default_from=P.period_from, default_to=P.period_to)
BAD_MONTH = Filter.build("", "2000-13", "2001-02", default_from=P.period_from, default_to=P.period_to)


def to_output(df: DataFrame) -> DataFrame:
    """DECIMAL columns as DOUBLE; other types unchanged."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def _wh(spark: SparkSession, sf_dir: str):
    return get_warehouse(spark, sf_dir, P)


def _dash(fn, flt: Filter = DEFAULT):
    return lambda spark, sf: to_output(fn(_wh(spark, sf), flt))


def _wh_fn(fn):
    return lambda spark, sf: to_output(fn(_wh(spark, sf)))


def _table(name: str):
    return lambda spark, sf: to_output(getattr(_wh(spark, sf), name))


def _stream(name: str):
    def run(spark, sf):
        from ledgerlens.streaming.runner import stream_run
        return to_output(getattr(stream_run(_wh(spark, sf)), name)())
    return run


def _page(name: str):
    return _wh_fn(lambda wh: PG.page_rows(wh, name))


def _sem(metric: str, dims: list[str], where: str | None = None):
    return lambda spark, sf: to_output(metric_query(_wh(spark, sf), [metric], dims, where))


SEM_DEFAULT_DIM = {"ar": "ar_company", "ap": "ap_company", "wc_kpi": "kpi_company", "inventory": "inv_company",
                   "cash_forecast": "cf_company"}


def filter_period_check(wh) -> DataFrame:
    """AR invoiced and paid by company for a company subset over a period
    given reversed (it is swapped)."""
    ar = wh.ar_items.filter(SUBSET.where("invoice_month"))
    per_month = ar.groupBy("company", "invoice_month").agg(F.count(F.lit(1)).alias("items"),
                                                           F.sum("amount_usd").alias("invoiced"))
    return (per_month.groupBy("company").agg(F.sum("items").alias("items"), F.sum("invoiced").alias("invoiced"),
                                             F.min("invoice_month").alias("first_month"),
                                             F.max("invoice_month").alias("last_month"))
              .transform(sorted_small("company")))


def early_flows(wh) -> DataFrame:
    return FL.monthly_flows(wh.ar_core, wh.ap_core, wh.params.history_start, EARLY_AS_OF)


def early_kpi(wh) -> DataFrame:
    flows = early_flows(wh)
    return KP.wc_monthly_kpi(flows, KP.inventory_monthly(flows, wh.dim_company), wh.dim_company, wh.params.kpi_start)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable] = {
        # sources, extracts, curated tables
        "src_journal_line": _table("journal"),
        "ar_base": _wh_fn(lambda wh: IT.ar_base(wh.journal).drop("item_bucket")),
        "ap_base": _wh_fn(lambda wh: IT.ap_base(wh.journal).drop("item_bucket")),
        "dim_customer": _table("dim_customer"),
        "dim_supplier": _table("dim_supplier"),
        "ar_items": _table("ar_items"),
        "ap_items": _table("ap_items"),
        "monthly_flows": _table("monthly_flows"),
        "inventory_monthly": _table("inventory_monthly"),
        "wc_monthly_kpi": _table("wc_monthly_kpi"),
        "cash_forecast": _table("cash_forecast"),
        "wc_opportunities": _table("wc_opportunities"),
        # filters
        "filter_companies": _wh_fn(D.filter_companies),
        "filter_months": _wh_fn(D.filter_months),
        "filter_period": _wh_fn(filter_period_check),
        # overview
        "ov_latest": _dash(D.ov_latest),
        "ov_latest_subset": _dash(D.ov_latest, SUBSET),
        "kpi_yoy_delta": _dash(D.kpi_yoy_delta),
        "ccc_bridge": _dash(D.ccc_bridge),
        "ov_trend": _dash(D.ov_trend),
        "ov_trend_bad_month": _dash(D.ov_trend, BAD_MONTH),
        "ov_by_company": _dash(D.ov_by_company),
        # cash (forecast-driven)
        "cash_forecast_13w": _dash(D.cash_forecast_13w),
        "cash_running": _dash(D.cash_running),
        # AR
        "ar_kpis": _dash(D.ar_kpis),
        "ar_kpis_subset": _dash(D.ar_kpis, SUBSET),
        "ar_on_time": _dash(D.ar_on_time),
        "ar_dso_trend": _dash(D.ar_dso_trend),
        "ar_dso_latest": _dash(D.ar_dso_latest),
        "ar_aging": _dash(D.ar_aging),
        "ar_top_overdue": _dash(D.ar_top_overdue),
        "ar_dunning": _dash(D.ar_dunning),
        "ar_by_segment": _dash(D.ar_by_segment),
        # AP
        "ap_kpis": _dash(D.ap_kpis),
        "ap_paid": _dash(D.ap_paid),
        "ap_dpo_trend": _dash(D.ap_dpo_trend),
        "ap_dpo_latest": _dash(D.ap_dpo_latest),
        "ap_discounts": _dash(D.ap_discounts),
        "ap_aging": _dash(D.ap_aging),
        "ap_top_suppliers": _dash(D.ap_top_suppliers),
        # early pay
        "ep_kpis": _dash(D.ep_kpis),
        "ep_by_program": _dash(D.ep_by_program),
        "ep_outcomes": _dash(D.ep_outcomes),
        "ep_dd_apr": _dash(D.ep_dd_apr),
        "ep_annual_purchases": _dash(D.ep_annual_purchases),
        "ep_whatif": _dash(D.ep_whatif),
        # inventory
        "inv_dio_trend": _dash(D.inv_dio_trend),
        "inv_trend_by_cat": _dash(D.inv_trend_by_cat),
        "inv_categories": _dash(D.inv_categories),
        "inv_kpis": _dash(D.inv_kpis),
        # opportunities
        "opp_rows": _dash(D.opp_rows),
        "opp_by_lever": _dash(D.opp_by_lever),
        "opp_by_company": _dash(D.opp_by_company),
        "opp_kpis": _dash(D.opp_kpis),
        "lever_company_pivot": _dash(D.lever_company_pivot),
        "share_of_total": _dash(D.ap_volume_share),
        # fact packs (topic facts with their own semantics) and report facts
        "ask_top10_overdue": _wh_fn(FA.ask_top10_overdue),
        "ask_ap_behaviour": _wh_fn(FA.ask_ap_behaviour),
        "ask_dd_yield": _wh_fn(FA.ask_dd_yield),
        "ask_top_levers": _wh_fn(FA.ask_top_levers),
        "ask_forecast_rows": _wh_fn(FA.ask_forecast_rows),
        "fact_pack": _wh_fn(FA.fact_pack),
        "fact_kpi_by_company": _wh_fn(FA.fact_kpi_by_company),
        "fact_kpi_total": _wh_fn(FA.fact_kpi_total),
        "fact_window": _wh_fn(FA.fact_window),
        "fact_ar_open": _wh_fn(FA.fact_ar_open),
        "fact_ar_all": _wh_fn(FA.fact_ar_all),
        "fact_ar_aging": _wh_fn(FA.fact_ar_aging),
        "fact_top5_overdue": _wh_fn(FA.fact_top5_overdue),
        "fact_ap_open": _wh_fn(FA.fact_ap_open),
        "fact_ap_all": _wh_fn(FA.fact_ap_all),
        "fact_ap_latest_month": _wh_fn(FA.fact_ap_latest_month),
        "fact_ap_by_program": _wh_fn(FA.fact_ap_by_program),
        "fact_dd_apr": _wh_fn(FA.fact_dd_apr),
        "fact_inventory_by_category": _wh_fn(FA.fact_inventory_by_category),
        "fact_cash_13w": _wh_fn(FA.fact_cash_13w),
        "fact_release_by_lever": _wh_fn(FA.fact_release_by_lever),
        "argmax_company": _wh_fn(FA.argmax_company),
        "report_pack": _wh_fn(FA.report_pack),
        # lineage and audit
        "lineage_counts": _wh_fn(LI.lineage_counts),
        "lineage_products": _wh_fn(LI.lineage_products),
        "bundle_audit": _wh_fn(LI.bundle_audit),
        "selftest_counts": _wh_fn(LI.selftest_counts),
        # subset snapshot
        "snapshot_subsets": _wh_fn(SN.snapshot_subsets),
        # every page for every subset, a row a cell, and distinct partners of trailing periods
        **{f"page_{name.replace('-', '_')}": _page(name) for name in PG.PAGES},
        "page_trailing_partners": _wh_fn(lambda wh: PG.pages(wh).trailing_partners()),
        # streaming refresh (equals the batch tables)
        "stream_ar_items": _stream("ar_items"),
        "stream_ap_items": _stream("ap_items"),
        "stream_monthly_flows": _stream("monthly_flows"),
        "stream_kpi_refresh": _stream("wc_monthly_kpi"),
        "stream_inventory": _stream("inventory_monthly"),
        "stream_forecast": _stream("cash_forecast"),
        # the same tables as of an earlier date
        "asof_ar_items": _wh_fn(lambda wh: IT.ar_status(wh.ar_core, EARLY_AS_OF)),
        "asof_ap_items": _wh_fn(lambda wh: IT.ap_status(wh.ap_core, EARLY_AS_OF)),
        "asof_monthly_flows": _wh_fn(early_flows),
        "asof_wc_monthly_kpi": _wh_fn(early_kpi),
        # open items at every month end, from the state calendar
        "asof_aging_series": _wh_fn(ST.aging_series),
        "asof_dunning_series": _wh_fn(ST.dunning_series),
    }
    # metric layer: every metric by company, plus the documented usage shape
    for m, (table, _) in METRICS.items():
        q[f"sem_{m}"] = _sem(m, [SEM_DEFAULT_DIM[table]])
    q["sem_disputed_ar_by_credit_risk"] = _sem("disputed_ar", ["AR.CREDIT_RISK"])
    q["sem_where_dimension"] = _sem("open_ar", ["ar_company"], "customer_segment = 'Enterprise' AND ar.credit_risk <> 'Low'")
    q["sem_where_synonym"] = _sem("payables.total_ap", ["program"], "`spend category` = 'Utilities'")
    q["sem_where_fact"] = _sem("total_revenue", ["kpi_company"], "dso_days > 40 AND region <> 'revenue'")
    q["sem_ap_by_program"] = lambda spark, sf: to_output(metric_query(
        _wh(spark, sf), ["total_ap", "open_ap", "total_discount_captured", "total_scf_funded"], ["program"]))
    return q
