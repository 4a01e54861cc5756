"""Working-capital levers: cash release versus target days, latest KPI month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import Params

# ---- fixed values (must equal the model being reproduced) ---------------
LEVER_DSO = ("Reduce DSO (collections, disputes, AR finance)", "AR", 42)
LEVER_DPO = ("Extend DPO via Supply Chain Finance", "AP", 60)
LEVER_DIO = ("Reduce DIO (slow-moving, safety stock)", "Inventory", 50)
LEVER_DISCOUNTS = ("Capture missed & dynamic discounts", "AP")
# -------------------------------------------------------------------------

OPP_COLUMNS = ["company_code", "company", "lever", "area", "current_days", "target_days", "cash_release_usd",
               "pnl_impact_usd"]


def latest_kpi(kpi: DataFrame) -> DataFrame:
    """Latest month per company (a window over companies x months rows)."""
    w = Window.partitionBy("company_code").orderBy(F.col("month_end").desc())
    return kpi.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def wc_opportunities(kpi: DataFrame, flows: DataFrame, inventory: DataFrame, ap: DataFrame,
                     params: Params) -> DataFrame:
    k = latest_kpi(kpi).select("company_code", "company", "dso", "dpo", "dio")
    cut = F.lit(params.cut_12m)
    f = (flows.filter(F.col("month_end") > cut).groupBy("company_code")
              .agg(F.sum("revenue_usd").alias("rev_12m"), F.sum("purchases_usd").alias("pur_12m")))
    inv = (inventory.filter(F.col("month_end") > cut).groupBy("company_code")
                    .agg(F.sum("cogs_usd").alias("cogs_12m")))
    disc = (ap.filter(F.col("invoice_date") > cut).groupBy("company_code")
              .agg(F.sum("discount_lost_usd").alias("lost"), F.sum("dd_opportunity_usd").alias("dd_opp")))

    def release(gap, base):
        # no day metric, no release (greatest would skip the null)
        return F.when(gap.isNotNull(),
                      F.round(F.greatest(gap, F.lit(0.0)) * F.col(base).cast("double") / F.lit(365.0), 0))

    kf = k.join(f, "company_code")
    dso = kf.select("company_code", "company", F.lit(LEVER_DSO[0]).alias("lever"), F.lit(LEVER_DSO[1]).alias("area"),
                    F.col("dso").alias("current_days"), F.lit(LEVER_DSO[2]).alias("target_days"),
                    release(F.col("dso") - LEVER_DSO[2], "rev_12m").alias("cash_release_usd"),
                    F.lit(0.0).alias("pnl_impact_usd"))
    dpo = kf.select("company_code", "company", F.lit(LEVER_DPO[0]), F.lit(LEVER_DPO[1]),
                    F.col("dpo"), F.lit(LEVER_DPO[2]),
                    release(F.lit(LEVER_DPO[2]) - F.col("dpo"), "pur_12m"), F.lit(0.0))
    dio = k.join(inv, "company_code").select(
        "company_code", "company", F.lit(LEVER_DIO[0]), F.lit(LEVER_DIO[1]), F.col("dio"), F.lit(LEVER_DIO[2]),
        release(F.col("dio") - LEVER_DIO[2], "cogs_12m"), F.lit(0.0))
    dsc = k.join(disc, "company_code").select(
        "company_code", "company", F.lit(LEVER_DISCOUNTS[0]), F.lit(LEVER_DISCOUNTS[1]),
        F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(0.0),
        F.round(F.col("lost") + F.col("dd_opp"), 0).cast("double"))
    # union by position: every branch lists the eight columns in the same order
    return dso.union(dpo).union(dio).union(dsc).toDF(*OPP_COLUMNS)
