"""Literal dimension tables.

These are constants of the model, not data: three companies, six inventory
categories, nine bank accounts.  Their size is fixed by this file, which is
the proven bound that makes broadcasting them safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---- fixed values (must equal the model being reproduced) ---------------
# company_code, company, currency, region, rate_to_usd
COMPANIES = [
    ("1000", "US Operations", "USD", "Americas", "1.0"),
    ("2100", "EU Operations", "EUR", "EMEA", "1.08"),
    ("5000", "Japan Operations", "JPY", "APAC", "0.0067"),
]

# inventory_category, cogs_share, target_dio, slow_moving_pct
INVENTORY_CATEGORIES = [
    ("Raw Materials", "0.34", 48, "0.06"),
    ("Work in Progress", "0.16", 22, "0.02"),
    ("Finished Goods", "0.30", 64, "0.11"),
    ("Spare Parts & MRO", "0.08", 140, "0.24"),
    ("Packaging", "0.07", 35, "0.05"),
    ("Consignment & Transit", "0.05", 18, "0.01"),
]

# company_code, bank_account_id, house_bank, account_purpose, base_balance_usd
BANK_ACCOUNTS = [
    ("1000", "BA-US-OPS", "JPMorgan Chase", "Operating", 6200000),
    ("1000", "BA-US-PAY", "Bank of America", "Payroll", 1400000),
    ("1000", "BA-US-INV", "JPMorgan Chase", "Investment", 3500000),
    ("2100", "BA-EU-OPS", "Deutsche Bank", "Operating", 4800000),
    ("2100", "BA-EU-PAY", "BNP Paribas", "Payroll", 1100000),
    ("2100", "BA-EU-INV", "Deutsche Bank", "Investment", 2200000),
    ("5000", "BA-JP-OPS", "MUFG Bank", "Operating", 3900000),
    ("5000", "BA-JP-PAY", "Mizuho Bank", "Payroll", 900000),
    ("5000", "BA-JP-INV", "SMBC", "Investment", 1800000),
]

# Test-data adapter: region of the partner's nation -> company code.
REGION_COMPANY = [
    ("AMERICA", "1000"),
    ("ASIA", "5000"),
    ("EUROPE", "2100"),
    ("AFRICA", "2100"),
    ("MIDDLE EAST", "2100"),
]
# -------------------------------------------------------------------------

RATE = T.DecimalType(10, 6)


def _local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """The rows as a local relation (``VALUES``): no task reads them."""
    def lit(v, f):
        text = "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
        return f"cast({text} as {f.dataType.simpleString()})"
    values = ", ".join("(" + ", ".join(lit(v, f) for v, f in zip(r, schema.fields)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(schema.fieldNames())})")


def dim_company(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("company_code", T.StringType(), False),
        T.StructField("company", T.StringType(), False),
        T.StructField("currency", T.StringType(), False),
        T.StructField("region", T.StringType(), False),
        T.StructField("rate_to_usd", RATE, False),
    ])
    return _local(spark, COMPANIES, schema)


def dim_inventory_category(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("inventory_category", T.StringType(), False),
        T.StructField("cogs_share", RATE, False),
        T.StructField("target_dio", T.IntegerType(), False),
        T.StructField("slow_moving_pct", RATE, False),
    ])
    return _local(spark, INVENTORY_CATEGORIES, schema)


def dim_bank_account(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("company_code", T.StringType(), False),
        T.StructField("bank_account_id", T.StringType(), False),
        T.StructField("house_bank", T.StringType(), False),
        T.StructField("account_purpose", T.StringType(), False),
        T.StructField("base_balance_usd", T.LongType(), False),
    ])
    return _local(spark, BANK_ACCOUNTS, schema)


def region_company(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("r_name", T.StringType(), False),
        T.StructField("company_code", T.StringType(), False),
    ])
    return _local(spark, REGION_COMPANY, schema)
