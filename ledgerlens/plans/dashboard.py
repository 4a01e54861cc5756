"""Dashboard queries: one DataFrame function per chart or card.

Every function takes the curated tables (a ``Warehouse``) and a ``Filter``
(companies + month period) and returns a small aggregated DataFrame.  The
heavy tables (AR/AP items) are only ever aggregated with partial
(map-side) aggregation; the monthly tables are companies x months rows.
Cross-company day metrics are weighted by their flow driver: DSO by
revenue, DPO by purchases, DIO by COGS.  Nothing is collected: client-side
post-steps of a dashboard (deltas, running balances, shares, what-if
scenarios) are expressed as DataFrame operations as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.filters import Filter
from ledgerlens.functions.measures import safe_ratio, sum_if, weighted_ratio, sorted_small
from ledgerlens.operators.lattice import company_names
from ledgerlens.sources.literals import COMPANIES

# ---- fixed values (must equal the model being reproduced) ---------------
AR_AGING_ORDER = ["Not Due", "1-30", "31-60", "61-90", "90+"]
AP_AGING_ORDER = ["Not Due", "1-30", "31-60", "60+"]
DD_ACCEL_DAYS = 30
WHATIF_EXTEND_DAYS = (0, 60, 5)
WHATIF_DD_PCT = (0, 100, 5)
TOP_CUSTOMERS = 15
TOP_SUPPLIERS = 15
# -------------------------------------------------------------------------


def _dso() -> Column:
    return weighted_ratio("dso", "revenue_usd").alias("dso")


def _dpo() -> Column:
    return weighted_ratio("dpo", "purchases_usd").alias("dpo")


def _dio() -> Column:
    return weighted_ratio("dio", "cogs_usd").alias("dio")


def _ccc() -> Column:
    """CCC of the rounded weighted parts."""
    return F.round(F.col("dso") + F.col("dio") - F.col("dpo"), 1).alias("ccc")


def _rank(col: str, order: list[str]) -> Column:
    r = F.lit(9)
    for i, v in reversed(list(enumerate(order))):
        r = F.when(F.col(col) == v, i).otherwise(r)
    return r


def _overdue(amount: str = "amount_usd") -> Column:
    return sum_if(F.col("days_past_due") > 0, amount)


# ---------------------------------------------------------------- filters
def filter_companies(wh) -> DataFrame:
    return wh.wc_monthly_kpi.select(F.col("company").alias("v")).distinct().transform(sorted_small("v"))


def filter_months(wh) -> DataFrame:
    return wh.wc_monthly_kpi.select(F.col("month").alias("v")).distinct().transform(sorted_small("v"))


# ---------------------------------------------------------------- overview
def ov_latest(wh, flt: Filter) -> DataFrame:
    k = wh.wc_monthly_kpi.filter(flt.where(extra=[F.col("month").isin(flt.prior, flt.month_to)]))
    g = k.groupBy("month").agg(
        _dso(), _dpo(), _dio(),
        F.sum("net_working_capital_usd").alias("nwc"), F.sum("ar_balance_usd").alias("ar"),
        F.sum("ap_balance_usd").alias("ap"), F.sum("inventory_usd").alias("inventory"),
        F.sum("ar_overdue_usd").alias("ar_overdue"))
    return g.select("month", _ccc(), "dso", "dpo", "dio", "nwc", "ar", "ap", "inventory", "ar_overdue").transform(sorted_small("month"))


def kpi_yoy_delta(wh, flt: Filter) -> DataFrame:
    """Latest month minus the same month a year before; null if either is missing."""
    lat = ov_latest(wh, flt)
    cols = ["dso", "dpo", "dio", "ccc", "nwc", "ar", "ap", "inventory"]

    def at(m, c):  # as the dashboard numbers, in DOUBLE
        return F.max(F.when(F.col("month") == m, F.col(c).cast("double")))

    return lat.agg(
        F.lit(flt.month_to).alias("month"), F.lit(flt.prior).alias("prior_month"),
        *[(at(flt.month_to, c) - at(flt.prior, c)).alias(c) for c in cols])


def ccc_bridge(wh, flt: Filter) -> DataFrame:
    """DSO + DIO - DPO = CCC as waterfall steps (name, base, value)."""
    cur = ov_latest(wh, flt).filter(F.col("month") == flt.month_to)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    steps = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("DSO").alias("name"), F.lit(0.0).alias("base"), z("dso").alias("value")),
        F.struct(F.lit(1).alias("step"), F.lit("+ DIO").alias("name"), z("dso").alias("base"),
                 z("dio").alias("value")),
        F.struct(F.lit(2).alias("step"), F.lit("- DPO").alias("name"),
                 (z("dso") + z("dio") - z("dpo")).alias("base"), z("dpo").alias("value")),
        F.struct(F.lit(3).alias("step"), F.lit("= CCC").alias("name"), F.lit(0.0).alias("base"),
                 z("ccc").alias("value")))
    return cur.select(F.inline(steps)).transform(sorted_small("step"))


def ov_trend(wh, flt: Filter) -> DataFrame:
    k = wh.wc_monthly_kpi.filter(flt.where("month"))
    g = k.groupBy("month").agg(_dso(), _dpo(), _dio(), F.sum("net_working_capital_usd").alias("nwc"))
    return g.select("month", _ccc(), "dso", "dpo", "dio", "nwc").transform(sorted_small("month"))


def ov_by_company(wh, flt: Filter) -> DataFrame:
    k = wh.wc_monthly_kpi.filter(flt.where(extra=[F.col("month") == flt.month_to]))
    return k.select(F.col("company").alias("name"), "region", "dso", "dpo", "dio", "ccc",
                    F.col("net_working_capital_usd").alias("nwc"), F.col("ar_balance_usd").alias("ar"),
                    F.col("ap_balance_usd").alias("ap"), F.col("inventory_usd").alias("inventory"),
                    "ar_overdue_pct").transform(sorted_small("name"))


# ---------------------------------------------------------------- cash
def _bank_latest(wh, flt: Filter) -> DataFrame:
    """Bank rows of the latest week.  The latest week is global, not per
    company: a scalar subquery over the whole table."""
    bank = wh.bank_balance_weekly
    latest = bank.agg(F.max("week_end")).scalar()
    return bank.filter((F.col("week_end") == latest) & flt.company_pred())


def cash_total(wh, flt: Filter) -> DataFrame:
    return _bank_latest(wh, flt).agg(F.max("week_end").alias("week_end"), F.sum("balance_usd").alias("balance"),
                                     F.countDistinct("bank_account_id").alias("accounts"))


def cash_trend(wh, flt: Filter) -> DataFrame:
    b = wh.bank_balance_weekly.filter(flt.where(F.date_format("week_end", "yyyy-MM")))
    return (b.groupBy(F.date_format("week_end", "yyyy-MM-dd").alias("week"), F.col("company").alias("name"))
             .agg(F.sum("balance_usd").alias("balance")).transform(sorted_small("week", "name")))


def cash_trend_pivot(wh, flt: Filter) -> DataFrame:
    """Week x company balances; a missing week for a company stays null."""
    names = _company_names(wh, flt)
    return cash_trend(wh, flt).groupBy("week").pivot("name", names).agg(F.first("balance")).transform(sorted_small("week"))


def cash_by_bank(wh, flt: Filter) -> DataFrame:
    return (_bank_latest(wh, flt).groupBy(F.col("house_bank").alias("name"))
            .agg(F.sum("balance_usd").alias("balance")).transform(sorted_small(F.desc("balance"), "name")))


def cash_by_purpose(wh, flt: Filter) -> DataFrame:
    return (_bank_latest(wh, flt).groupBy(F.col("account_purpose").alias("name"))
            .agg(F.sum("balance_usd").alias("balance")).transform(sorted_small(F.desc("balance"), "name")))


def cash_forecast_13w(wh, flt: Filter) -> DataFrame:
    fc = wh.cash_forecast.filter(flt.company_pred())
    net = F.col("ar_receipts_usd") - F.col("ap_payments_usd") - F.col("payroll_usd") - F.col("other_opex_usd")
    return (fc.groupBy("week_no")
              .agg(F.date_format(F.min("week_end"), "yyyy-MM-dd").alias("week_end"),
                   F.sum("ar_receipts_usd").alias("receipts"), F.sum("ap_payments_usd").alias("ap_payments"),
                   F.sum("payroll_usd").alias("payroll"), F.sum("other_opex_usd").alias("other_opex"),
                   F.sum(net).alias("net"))
              .transform(sorted_small("week_no")))


def cash_running(wh, flt: Filter) -> DataFrame:
    """Closing balance per forecast week from the latest bank balance, with
    the 13-week net, end balance and low point (13 rows, one window)."""
    start = cash_total(wh, flt).select(F.coalesce(F.col("balance"), F.lit(0))).scalar()
    fc = cash_forecast_13w(wh, flt).withColumn("start_balance", start)
    run = Window.orderBy("week_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(1))
    out = (fc.withColumn("payments", F.col("ap_payments") + F.col("payroll") + F.col("other_opex"))
             .withColumn("closing_balance", F.col("start_balance") + F.sum("net").over(run)))
    return (out.withColumn("forecast_net", F.sum("net").over(whole))
               .withColumn("forecast_end_balance", F.col("start_balance") + F.col("forecast_net"))
               .withColumn("min_balance", F.min("closing_balance").over(whole))
               .select("week_no", "week_end", "receipts", "payments", "net", "closing_balance", "start_balance",
                       "forecast_net", "forecast_end_balance", "min_balance")
               .transform(sorted_small("week_no")))


# ---------------------------------------------------------------- AR
def _ar_open(wh, flt: Filter) -> DataFrame:
    return wh.ar_items.filter(flt.where(extra=[F.col("is_open")]))


def ar_kpis(wh, flt: Filter) -> DataFrame:
    return _ar_open(wh, flt).agg(
        F.sum("amount_usd").alias("open_ar"), _overdue().alias("overdue_ar"),
        F.round(safe_ratio(F.lit(100.0) * _overdue().cast("double"), F.sum("amount_usd")), 1).alias("overdue_pct"),
        sum_if(F.col("is_disputed"), "amount_usd").alias("disputed"),
        sum_if(F.col("has_promise_to_pay"), "amount_usd").alias("promised"),
        F.count(F.lit(1)).alias("open_items"), F.countDistinct("customer_id").alias("customers"))


def _on_time_pct() -> Column:
    return F.round(F.lit(100) * F.avg(F.when(F.col("paid_on_time"), 1).otherwise(0)), 1)


def ar_on_time(wh, flt: Filter) -> DataFrame:
    ar = wh.ar_items.filter(flt.where("invoice_month", extra=[~F.col("is_open")]))
    return ar.agg(_on_time_pct().alias("on_time_pct"), F.round(F.avg("days_to_pay"), 1).alias("avg_days_to_pay"),
                  F.sum("amount_usd").alias("invoiced"))


def ar_dso_trend(wh, flt: Filter) -> DataFrame:
    k = wh.wc_monthly_kpi.filter(flt.where("month"))
    return (k.groupBy("month").agg(_dso(), F.sum("ar_balance_usd").alias("ar"),
                                   F.sum("ar_overdue_usd").alias("overdue")).transform(sorted_small("month")))


def ar_dso_latest(wh, flt: Filter) -> DataFrame:
    """The card value: DSO of the last month in the trend."""
    return ar_dso_trend(wh, flt).agg(F.max_by("dso", "month").alias("dso"))


def ar_aging(wh, flt: Filter) -> DataFrame:
    return (_ar_open(wh, flt).groupBy(F.col("aging_bucket").alias("name"))
            .agg(F.sum("amount_usd").alias("amount"), F.count(F.lit(1)).alias("items"))
            .transform(sorted_small(_rank("name", AR_AGING_ORDER), "name")))


def ar_top_overdue(wh, flt: Filter, k: int = TOP_CUSTOMERS) -> DataFrame:
    """Top customers by overdue amount; partners sharing a name are merged.

    Numeric parts are pre-aggregated by (name, segment, risk) with hash
    aggregation; the string ``max`` picks then run on that small frame
    instead of sorting every open item."""
    fine = _ar_open(wh, flt).groupBy("customer_name", "segment", "credit_risk").agg(
        F.sum("amount_usd").alias("open_ar"), _overdue().alias("overdue"),
        F.max("days_past_due").alias("max_dpd"), sum_if(F.col("is_disputed"), "amount_usd").alias("disputed"),
        sum_if(F.col("has_promise_to_pay"), "amount_usd").alias("promise_to_pay"))
    g = fine.groupBy(F.col("customer_name").alias("customer")).agg(
        F.max("segment").alias("segment"), F.max("credit_risk").alias("risk"),
        F.sum("open_ar").alias("open_ar"), F.sum("overdue").alias("overdue"), F.max("max_dpd").alias("max_dpd"),
        F.sum("disputed").alias("disputed"), F.sum("promise_to_pay").alias("promise_to_pay"))
    return g.filter(F.col("overdue") > 0).orderBy(F.desc("overdue"), "customer").limit(k)


def ar_dunning(wh, flt: Filter) -> DataFrame:
    name = F.concat(F.lit("Level "), F.coalesce(F.col("dunning_level"), F.lit(0)).cast("string"))
    return (_ar_open(wh, flt).groupBy(name.alias("name"))
            .agg(F.count(F.lit(1)).alias("items"), F.sum("amount_usd").alias("amount")).transform(sorted_small("name")))


def ar_by_segment(wh, flt: Filter) -> DataFrame:
    return (_ar_open(wh, flt).groupBy(F.col("segment").alias("name"))
            .agg(F.sum("amount_usd").alias("open_ar"), _overdue().alias("overdue"))
            .transform(sorted_small(F.desc("open_ar"), "name")))


# ---------------------------------------------------------------- AP
def _ap_open(wh, flt: Filter) -> DataFrame:
    return wh.ap_items.filter(flt.where(extra=[F.col("is_open")]))


def ap_kpis(wh, flt: Filter) -> DataFrame:
    return _ap_open(wh, flt).agg(F.sum("amount_usd").alias("open_ap"), _overdue().alias("overdue_ap"),
                                 F.count(F.lit(1)).alias("open_items"),
                                 F.countDistinct("supplier_id").alias("suppliers"))


def ap_paid(wh, flt: Filter) -> DataFrame:
    ap = wh.ap_items.filter(flt.where("invoice_month", extra=[~F.col("is_open")]))
    return ap.agg(F.round(F.avg("days_to_pay"), 1).alias("avg_days_to_pay"), _on_time_pct().alias("on_time_pct"),
                  sum_if(F.col("paid_early_no_benefit"), "amount_usd").alias("paid_early_no_benefit"),
                  F.sum("discount_captured_usd").alias("discount_captured"),
                  F.sum("discount_lost_usd").alias("discount_lost"))


def ap_dpo_trend(wh, flt: Filter) -> DataFrame:
    k = wh.wc_monthly_kpi.filter(flt.where("month"))
    return k.groupBy("month").agg(_dpo(), F.sum("ap_balance_usd").alias("ap")).transform(sorted_small("month"))


def ap_dpo_latest(wh, flt: Filter) -> DataFrame:
    """The card value: DPO of the last month in the trend."""
    return ap_dpo_trend(wh, flt).agg(F.max_by("dpo", "month").alias("dpo"))


def ap_discounts(wh, flt: Filter) -> DataFrame:
    ap = wh.ap_items.filter(flt.where("invoice_month"))
    return (ap.groupBy(F.col("invoice_month").alias("month"))
              .agg(F.sum("discount_captured_usd").alias("captured"), F.sum("discount_lost_usd").alias("lost"))
              .transform(sorted_small("month")))


def ap_aging(wh, flt: Filter) -> DataFrame:
    return (_ap_open(wh, flt).groupBy(F.col("aging_bucket").alias("name"))
            .agg(F.sum("amount_usd").alias("amount"), F.count(F.lit(1)).alias("items"))
            .transform(sorted_small(_rank("name", AP_AGING_ORDER), "name")))


def ap_top_suppliers(wh, flt: Filter, k: int = TOP_SUPPLIERS) -> DataFrame:
    attrs = ["category", "supplier_segment", "early_pay_program", "payment_terms"]
    fine = _ap_open(wh, flt).groupBy("supplier_name", *attrs).agg(
        F.sum("amount_usd").alias("open_ap"), _overdue().alias("overdue"))
    g = fine.groupBy(F.col("supplier_name").alias("supplier")).agg(
        F.max("category").alias("category"), F.max("supplier_segment").alias("segment"),
        F.max("early_pay_program").alias("program"), F.max("payment_terms").alias("terms"),
        F.sum("open_ap").alias("open_ap"), F.sum("overdue").alias("overdue"))
    return g.orderBy(F.desc("open_ap"), "supplier").limit(k)


# ---------------------------------------------------------------- early pay
def _ap_period(wh, flt: Filter) -> DataFrame:
    return wh.ap_items.filter(flt.where("invoice_month"))


def ep_kpis(wh, flt: Filter) -> DataFrame:
    return _ap_period(wh, flt).agg(
        F.sum("amount_usd").alias("volume"), F.sum("discount_captured_usd").alias("discount_captured"),
        F.sum("discount_lost_usd").alias("discount_lost"), F.sum("dd_opportunity_usd").alias("dd_opportunity"),
        F.sum("scf_funded_usd").alias("scf_funded"),
        sum_if(F.col("early_pay_program") == "Standard", "amount_usd").alias("standard_volume"))


def ep_by_program(wh, flt: Filter) -> DataFrame:
    return (_ap_period(wh, flt).groupBy(F.col("early_pay_program").alias("name"))
            .agg(F.sum("amount_usd").alias("volume"), F.countDistinct("supplier_id").alias("suppliers"),
                 F.sum("discount_captured_usd").alias("captured"),
                 F.sum("dd_opportunity_usd").alias("dd_opportunity"), F.sum("scf_funded_usd").alias("scf_funded"))
            .transform(sorted_small(F.desc("volume"), "name")))


def ep_outcomes(wh, flt: Filter) -> DataFrame:
    return (_ap_period(wh, flt).groupBy(F.col("payment_outcome").alias("name"))
            .agg(F.count(F.lit(1)).alias("items"), F.sum("amount_usd").alias("volume"),
                 F.sum("discount_captured_usd").alias("captured"), F.sum("discount_lost_usd").alias("lost"))
            .transform(sorted_small(F.desc("volume"), "name")))


def _accel(floor: int) -> Column:
    # GREATEST(terms - days_to_pay, floor) is null while days_to_pay is null
    dtp = F.col("days_to_pay")
    return F.when(dtp.isNotNull(), F.greatest(F.col("terms_days") - dtp, F.lit(floor)))


def ep_dd_apr(wh, flt: Filter) -> DataFrame:
    dd = _ap_period(wh, flt).filter(F.col("payment_outcome") == "DD Accepted")
    cap = F.sum("discount_captured_usd").cast("double")
    amt = F.sum("amount_usd").cast("double")
    avg1 = F.avg(_accel(1))
    apr = F.lit(100.0) * cap / F.when(amt != 0, amt) * F.lit(365.0) / F.when(avg1 != 0, avg1)
    return dd.agg(F.round(apr, 1).alias("dd_apr_pct"), F.round(F.avg(_accel(0)), 1).alias("days_accelerated"))


def ep_annual_purchases(wh, flt: Filter) -> DataFrame:
    k = wh.wc_monthly_kpi.filter(flt.where("month"))
    g = k.agg(F.sum("purchases_usd").alias("purchases"), F.countDistinct("month").alias("months"))
    return g.select("purchases", "months",
                    F.when(F.col("months") > 0, F.col("purchases").cast("double") * F.lit(12.0) / F.col("months"))
                     .otherwise(F.lit(0.0)).alias("annual_purchases"))


def ep_whatif(wh, flt: Filter) -> DataFrame:
    """Scenario grid of the two what-if sliders, from the period's KPIs:
    cash released by extending supplier terms, and discount yield from moving
    Standard suppliers onto dynamic discounting."""
    # the period's KPIs as scalar subqueries on the one-row annual figure
    base = ep_annual_purchases(wh, flt).select(
        "annual_purchases",
        ep_kpis(wh, flt).select("standard_volume").scalar().alias("standard_volume"),
        ep_dd_apr(wh, flt).select("dd_apr_pct").scalar().alias("dd_apr_pct"))
    lo, hi, st = WHATIF_EXTEND_DAYS
    ext = base.select(F.lit("extend_dpo_days").alias("lever"),
                      F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(st))).alias("setting"), "*")
    ext = ext.select("lever", "setting",
                     (F.col("setting") * F.col("annual_purchases") / F.lit(365.0)).alias("value"))
    lo, hi, st = WHATIF_DD_PCT
    dd = base.select(F.lit("dd_share_pct").alias("lever"),
                     F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(st))).alias("setting"), "*")
    apr = F.coalesce(F.col("dd_apr_pct"), F.lit(0.0))
    dd = dd.select("lever", "setting",
                   (F.col("setting") / F.lit(100.0) * F.col("standard_volume").cast("double") * (apr / F.lit(100.0))
                    * (F.lit(float(DD_ACCEL_DAYS)) / F.lit(365.0))).alias("value"))
    return ext.unionByName(dd).transform(sorted_small("lever", "setting"))


# ---------------------------------------------------------------- inventory
def inv_dio_trend(wh, flt: Filter) -> DataFrame:
    k = wh.wc_monthly_kpi.filter(flt.where("month"))
    return k.groupBy("month").agg(_dio(), F.sum("inventory_usd").alias("inventory")).transform(sorted_small("month"))


def inv_trend_by_cat(wh, flt: Filter) -> DataFrame:
    i = wh.inventory_monthly.filter(flt.where("month"))
    return (i.groupBy("month", F.col("inventory_category").alias("name"))
             .agg(F.sum("inventory_value_usd").alias("value")).transform(sorted_small("month", "name")))


def inv_categories(wh, flt: Filter) -> DataFrame:
    """Latest-month categories; DIO here is value / COGS * 365 / 12."""
    i = wh.inventory_monthly.filter(flt.where(extra=[F.col("month") == flt.month_to]))
    c = F.broadcast(wh.dim_inventory_category.select("inventory_category", "target_dio"))
    g = (i.join(c, "inventory_category", "left").groupBy(F.col("inventory_category").alias("name"))
          .agg(F.sum("inventory_value_usd").alias("value"),
               F.sum(F.col("inventory_value_usd") * F.col("slow_moving_pct")).alias("slow_moving"),
               F.round(F.sum("inventory_value_usd").cast("double")
                       / F.when(F.sum("cogs_usd") != 0, F.sum("cogs_usd").cast("double")) * F.lit(365.0) / F.lit(12.0),
                       1).alias("dio"),
               F.max("target_dio").alias("target_dio")))
    return (g.withColumn("gap_days", F.col("dio") - F.col("target_dio"))
             .transform(sorted_small(F.desc("value"), "name")))


def inv_kpis(wh, flt: Filter) -> DataFrame:
    cats = inv_categories(wh, flt)
    tot = cats.agg(F.sum("value").alias("inventory"), F.sum("slow_moving").alias("slow_moving"),
                   F.count(F.when(F.col("gap_days") > 0, 1)).alias("over_target"))
    dio = inv_dio_trend(wh, flt).agg(F.max_by("dio", "month")).scalar()
    return (tot.withColumn("dio", dio)
               .select(F.lit(flt.month_to).alias("month"), "inventory", "slow_moving",
                       F.when(F.coalesce(F.col("inventory"), F.lit(0)) != 0,
                              F.lit(100.0) * F.col("slow_moving").cast("double") / F.col("inventory").cast("double"))
                        .otherwise(F.lit(0.0)).alias("slow_moving_pct"),
                       "dio", "over_target"))


# ---------------------------------------------------------------- opportunities
def _opp(wh, flt: Filter) -> DataFrame:
    return wh.wc_opportunities.filter(flt.company_pred())


def opp_rows(wh, flt: Filter) -> DataFrame:
    return _opp(wh, flt).select(
        "company", "lever", "area", "current_days", "target_days",
        F.col("cash_release_usd").alias("cash_release"), F.col("pnl_impact_usd").alias("pnl_impact")
    ).transform(sorted_small(F.desc("cash_release"), "company", "lever"))


def opp_by_lever(wh, flt: Filter) -> DataFrame:
    return (_opp(wh, flt).groupBy(F.col("lever").alias("name"))
            .agg(F.max("area").alias("area"), F.sum("cash_release_usd").alias("cash_release"),
                 F.sum("pnl_impact_usd").alias("pnl_impact"))
            .transform(sorted_small(F.desc("cash_release"), "name")))


def opp_by_company(wh, flt: Filter) -> DataFrame:
    return (_opp(wh, flt).groupBy(F.col("company").alias("name"))
            .agg(F.sum("cash_release_usd").alias("cash_release"), F.sum("pnl_impact_usd").alias("pnl_impact"))
            .transform(sorted_small(F.desc("cash_release"), "name")))


def opp_kpis(wh, flt: Filter) -> DataFrame:
    return _opp(wh, flt).agg(F.sum("cash_release_usd").alias("cash_release"),
                             F.sum("pnl_impact_usd").alias("pnl_impact"),
                             F.countDistinct("lever").alias("levers"))


def lever_company_pivot(wh, flt: Filter) -> DataFrame:
    """Lever x company cash release; a missing (lever, company) is 0."""
    names = _company_names(wh, flt)
    p = _opp(wh, flt).groupBy("lever").pivot("company", names).agg(F.sum("cash_release_usd"))
    return p.select("lever", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names]).transform(sorted_small("lever"))


def _company_names(wh, flt: Filter) -> list[str]:
    """Pivot columns: the companies of the company dimension."""
    if wh.companies is None:
        names = [c[1] for c in COMPANIES]
    else:
        names = company_names(wh.dim_company)
    return sorted(c for c in names if not flt.companies or c in flt.companies)


# ---------------------------------------------------------------- charts
def share_of_total(df: DataFrame, name_col: str, value_col: str) -> DataFrame:
    """Ranked share of a small grouped result (pie shown as ranked bars):
    percent = round(1000 * value / total) / 10."""
    v = F.col("value")
    tot = F.sum("value").over(Window.partitionBy(F.lit(1)))
    pct = F.floor(F.lit(1000.0) * v / F.when(tot != 0, tot).otherwise(F.lit(1.0)) + F.lit(0.5)) / F.lit(10.0)
    return (df.select(F.col(name_col).alias("name"), F.col(value_col).cast("double").alias("value"))
              .withColumn("percent", pct)
              .transform(sorted_small(F.desc("value"), "name")))


def ap_volume_share(wh, flt: Filter) -> DataFrame:
    return share_of_total(ep_by_program(wh, flt), "name", "volume")
