"""Inventory model and monthly working-capital KPIs.

Both run on the monthly flows (companies x months rows), so their windows
partition by company over a few hundred rows at any data size.  Trailing
windows are by rows, not by calendar months: a gap month widens the span.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.measures import MONEY, safe_ratio
from ledgerlens.sources.literals import INVENTORY_CATEGORIES, RATE

# ---- fixed values (must equal the model being reproduced) ---------------
COGS_RATIO = 0.62
INVENTORY_DRIFT = 0.006
INVENTORY_WAVE = 0.04
SLOW_MOVING_DRIFT = 0.01
COMPANY_INVENTORY_FACTOR = {"5000": 1.15, "2100": 0.95}  # others 1.0
DAYS_IN_QUARTER = 91
# -------------------------------------------------------------------------

INVENTORY_COLUMNS = ["company_code", "company", "month_end", "month", "inventory_category", "cogs_usd",
                     "inventory_value_usd", "slow_moving_pct", "is_demo_enrichment"]
KPI_COLUMNS = ["company_code", "company", "region", "month_end", "month", "revenue_usd", "purchases_usd",
               "cogs_usd", "ar_balance_usd", "ar_overdue_usd", "ap_balance_usd", "inventory_usd",
               "net_working_capital_usd", "dso", "dpo", "dio", "ccc", "ar_overdue_pct",
               "discount_captured_usd", "discount_lost_usd"]


def _trailing(order_col: str = "month_end") -> Window:
    return Window.partitionBy("company_code").orderBy(order_col).rowsBetween(-2, Window.currentRow)


def _category_rows(categories) -> Column:
    """The (literal) category table as a generator column: one struct per category."""
    return F.inline(F.array(*[
        F.struct(F.lit(name).alias("inventory_category"), F.lit(share).cast(RATE).alias("cogs_share"),
                 F.lit(target).cast("int").alias("target_dio"), F.lit(slow).cast(RATE).alias("slow_moving_pct"))
        for name, share, target, slow in categories]))


def inventory_monthly(flows: DataFrame, dim_company: DataFrame, categories=INVENTORY_CATEGORIES) -> DataFrame:
    """One row per company, month and inventory category.

    ``categories`` are the literal (name, cogs share, target DIO, slow-moving
    %) rows; they are generated into every month row (no join)."""
    w3 = _trailing()
    idx_w = Window.partitionBy("company_code").orderBy("month_end")
    f = flows.select(
        "company_code", "month_end", "month",
        (F.sum("revenue_usd").over(w3).cast("double") / F.count(F.lit(1)).over(w3)).alias("rev_3m_avg"),
        F.row_number().over(idx_w).alias("m_idx"))
    idx = F.col("m_idx").cast("double")
    factor = F.lit(1.0)
    for code, val in COMPANY_INVENTORY_FACTOR.items():
        factor = F.when(F.col("company_code") == code, F.lit(val)).otherwise(factor)
    cogs_d = F.col("rev_3m_avg") * F.lit(COGS_RATIO) * F.col("cogs_share").cast("double")
    shape = F.lit(1.0) + F.lit(INVENTORY_DRIFT) * idx + F.lit(INVENTORY_WAVE) * F.sin(idx / F.lit(2.0))
    value = cogs_d / F.lit(30.0) * F.col("target_dio").cast("double") * shape * factor
    comp = F.broadcast(dim_company.select("company_code", "company"))
    return (f.select("*", _category_rows(categories)).join(comp, "company_code")
             .select(
                 "company_code", "company", "month_end", "month", "inventory_category",
                 F.round(cogs_d, 2).cast(MONEY).alias("cogs_usd"),
                 F.round(value, 2).cast(MONEY).alias("inventory_value_usd"),
                 F.round(F.col("slow_moving_pct").cast("double") * (F.lit(1.0) + F.lit(SLOW_MOVING_DRIFT) * idx), 4)
                 .cast("decimal(10,4)").alias("slow_moving_pct"),
                 F.lit(True).alias("is_demo_enrichment")))


def wc_monthly_kpi(flows: DataFrame, inventory: DataFrame, dim_company: DataFrame, kpi_start: dt.date) -> DataFrame:
    inv = (inventory.groupBy("company_code", "month_end")
                    .agg(F.sum("inventory_value_usd").alias("inventory_usd"), F.sum("cogs_usd").alias("cogs_usd")))
    w3 = _trailing()
    f = (flows.join(inv, ["company_code", "month_end"])
              .withColumn("rev_3m", F.sum("revenue_usd").over(w3))
              .withColumn("pur_3m", F.sum("purchases_usd").over(w3))
              .withColumn("cogs_3m", F.sum("cogs_usd").over(w3)))
    q = float(DAYS_IN_QUARTER)
    dso_x = safe_ratio("ar_balance_usd", "rev_3m") * q
    dpo_x = safe_ratio("ap_balance_usd", "pur_3m") * q
    dio_x = safe_ratio("inventory_usd", "cogs_3m") * q
    comp = F.broadcast(dim_company.select("company_code", "company", "region"))
    return (f.join(comp, "company_code")
             .filter(F.col("month_end") >= F.lit(kpi_start))
             .select(
                 "company_code", "company", "region", "month_end", "month",
                 F.col("revenue_usd").cast(MONEY).alias("revenue_usd"),
                 F.col("purchases_usd").cast(MONEY).alias("purchases_usd"),
                 F.col("cogs_usd").cast(MONEY).alias("cogs_usd"),
                 F.col("ar_balance_usd").cast(MONEY).alias("ar_balance_usd"),
                 F.col("ar_overdue_usd").cast(MONEY).alias("ar_overdue_usd"),
                 F.col("ap_balance_usd").cast(MONEY).alias("ap_balance_usd"),
                 F.col("inventory_usd").cast(MONEY).alias("inventory_usd"),
                 (F.col("ar_balance_usd") + F.col("inventory_usd") - F.col("ap_balance_usd")).cast(MONEY)
                 .alias("net_working_capital_usd"),
                 F.round(dso_x, 1).alias("dso"),
                 F.round(dpo_x, 1).alias("dpo"),
                 F.round(dio_x, 1).alias("dio"),
                 F.round(dso_x + dio_x - dpo_x, 1).alias("ccc"),
                 F.round(safe_ratio("ar_overdue_usd", "ar_balance_usd"), 4).alias("ar_overdue_pct"),
                 "discount_captured_usd", "discount_lost_usd"))
