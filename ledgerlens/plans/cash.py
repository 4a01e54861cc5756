"""Bank balances (demo model) and the 13-week cash forecast."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.config import Params
from ledgerlens.functions.bucket import raw_bucket
from ledgerlens.functions.measures import MONEY
from ledgerlens.sources.literals import dim_bank_account

# ---- fixed values (must equal the model being reproduced) ---------------
BANK_TREND = 0.0045
BANK_WAVE = 0.06
BANK_WAVE_PERIOD = 2.2
PAYROLL_DIP = -0.25
WEEKS_PER_MONTH = 4.33
RECEIPTS_SHARE, RECEIPTS_FROM_WEEK = 0.55, 6
PAYMENTS_SHARE, PAYMENTS_FROM_WEEK = 0.35, 8
PAYROLL_SHARE = 0.18
OPEX_SHARE = 0.08
# -------------------------------------------------------------------------

BANK_COLUMNS = ["company_code", "company", "bank_account_id", "house_bank", "account_purpose", "week_end",
                "balance_usd", "is_demo_enrichment"]
FORECAST_COLUMNS = ["company_code", "company", "week_no", "week_end", "ar_receipts_usd", "ap_payments_usd",
                    "payroll_usd", "other_opex_usd"]
DUE_KEYS = ["side", "company_code", "invoice_date", "expected"]


def weeks(spark: SparkSession, params: Params) -> DataFrame:
    """Row generator: ``i`` = 0..n-1 and the Friday ``week_end`` of week i."""
    return (spark.range(params.bank_weeks)
                 .select(F.col("id").cast("int").alias("i"))
                 .withColumn("week_end", F.date_add(F.lit(params.bank_first_week), F.col("i") * 7)))


def _week_index(n: int, first: int = 0):
    """Generator column first..first+n-1 (one output row per week for each input row)."""
    return F.explode(F.sequence(F.lit(first), F.lit(first + n - 1)))


def bank_balance_weekly(spark: SparkSession, params: Params, dim_company: DataFrame) -> DataFrame:
    acct = dim_bank_account(spark)
    i = F.col("i").cast("double")
    shift = (raw_bucket("bank_account_id") % 7).cast("double")
    payroll = F.when((F.col("account_purpose") == "Payroll") & (F.col("i") % 2 == 0), F.lit(PAYROLL_DIP)) \
               .otherwise(F.lit(0.0))
    factor = F.lit(1.0) - F.lit(BANK_TREND) * i + F.lit(BANK_WAVE) * F.sin(i / F.lit(BANK_WAVE_PERIOD) + shift) + payroll
    comp = F.broadcast(dim_company.select("company_code", "company"))
    acct_weeks = (acct.select("*", _week_index(params.bank_weeks).alias("i"))
                      .withColumn("week_end", F.date_add(F.lit(params.bank_first_week), F.col("i") * 7)))
    return (acct_weeks.join(comp, "company_code")
                .filter(F.col("week_end") <= F.lit(params.bank_last_week))
                .select("company_code", "company", "bank_account_id", "house_bank", "account_purpose", "week_end",
                        F.round(F.col("base_balance_usd").cast("double") * factor, 2).cast(MONEY).alias("balance_usd"),
                        F.lit(True).alias("is_demo_enrichment")))


def _forecast_week(date_col: str, params: Params):
    days = F.datediff(F.col(date_col), F.lit(params.as_of))
    return F.least(F.greatest(F.ceil(days / F.lit(7.0)), F.lit(1)), F.lit(params.forecast_weeks)).cast("int")


def due_parts(ar: DataFrame, ap: DataFrame) -> DataFrame:
    """Amounts of the AR and AP cores by ``DUE_KEYS``.  Additive; its size
    follows the calendar and the payment terms, not the items."""
    def part(core: DataFrame, side: str, day: str) -> DataFrame:
        return (core.select(F.lit(side).alias("side"), "company_code", "invoice_date", F.col(day).alias("expected"),
                            "amount_usd").groupBy(*DUE_KEYS).agg(F.sum("amount_usd").cast(MONEY).alias("amount_usd")))
    return part(ar, "ar", "expected_clearing_date").unionByName(part(ap, "ap", "expected_payment_date"))


def open_parts(due: DataFrame, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """What was open on ``as_of`` of ``due_parts``: AR and AP frames that
    ``cash_forecast`` takes in place of the items."""
    there = due.filter((F.col("invoice_date") <= F.lit(as_of)) & (F.col("expected") > F.lit(as_of)))

    def side(name: str, day: str) -> DataFrame:
        return there.filter(F.col("side") == name).select("company_code", F.col("expected").alias(day), "amount_usd",
                                                          F.lit(True).alias("is_open"))
    return side("ar", "expected_clearing_date"), side("ap", "expected_payment_date")


def cash_forecast(spark: SparkSession, params: Params, ar: DataFrame, ap: DataFrame, flows: DataFrame,
                  dim_company: DataFrame) -> DataFrame:
    """Open AR receipts and AP payments by forecast week (everything later than
    the horizon falls in the last week), plus modelled receipts, payments,
    payroll and opex from the mean monthly revenue of the last six months."""
    wk = (dim_company.select("company_code").distinct()
          .select("company_code", _week_index(params.forecast_weeks, first=1).alias("week_no")))
    inflow = (ar.filter("is_open").groupBy("company_code", _forecast_week("expected_clearing_date", params)
                                           .alias("week_no"))
                .agg(F.sum("amount_usd").alias("inflow")))
    outflow = (ap.filter("is_open").groupBy("company_code", _forecast_week("expected_payment_date", params)
                                            .alias("week_no"))
                 .agg(F.sum("amount_usd").alias("outflow")))
    rev = (flows.filter(F.col("month_end") > F.lit(params.cut_6m))
                .groupBy("company_code").agg((F.sum("revenue_usd").cast("double") / F.count(F.lit(1)))
                                              .alias("avg_rev")))
    comp = F.broadcast(dim_company.select("company_code", "company"))
    wno = F.col("week_no")
    avg_rev = F.col("avg_rev")
    weekly = avg_rev / F.lit(WEEKS_PER_MONTH)
    return (F.broadcast(wk).join(comp, "company_code").join(rev, "company_code")
             .join(inflow, ["company_code", "week_no"], "left")
             .join(outflow, ["company_code", "week_no"], "left")
             .select(
                 "company_code", "company", "week_no",
                 F.date_add(F.lit(params.as_of), wno * 7).alias("week_end"),
                 F.round(F.coalesce(F.col("inflow"), F.lit(0)).cast("double")
                         + F.when(wno > RECEIPTS_FROM_WEEK, weekly * F.lit(RECEIPTS_SHARE)).otherwise(F.lit(0.0)), 2)
                 .cast(MONEY).alias("ar_receipts_usd"),
                 F.round(F.coalesce(F.col("outflow"), F.lit(0)).cast("double")
                         + F.when(wno > PAYMENTS_FROM_WEEK, weekly * F.lit(PAYMENTS_SHARE)).otherwise(F.lit(0.0)), 2)
                 .cast(MONEY).alias("ap_payments_usd"),
                 F.round(F.when(wno % 2 == 0, avg_rev * F.lit(PAYROLL_SHARE)).otherwise(F.lit(0.0)), 2)
                 .cast(MONEY).alias("payroll_usd"),
                 F.round(weekly * F.lit(OPEX_SHARE), 2).cast(MONEY).alias("other_opex_usd")))
