"""Partner dimensions derived from the journal (demo enrichment).

Distinct partner ids get a dense 1-based number in string order; names come
from fixed word lists indexed by that number (so names repeat every 91
partners), and all behaviour attributes from the 0..99 bucket of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.bucket import bucket100
from ledgerlens.operators.dense_index import dense_index

# ---- fixed values (must equal the model being reproduced) ---------------
CUSTOMER_NAME_A = ["Apex", "Summit", "Harbor", "Pioneer", "Crestline", "Meridian", "Atlas", "Beacon",
                   "Keystone", "Silverline", "Northgate", "Evergreen", "Bluewater"]
CUSTOMER_NAME_B = ["Retail Group", "Industries", "Distribution", "Health Systems", "Foods", "Electronics",
                   "Logistics"]
SUPPLIER_NAME_A = ["Northwind", "Contoso", "Fabrikam", "Tailspin", "Litware", "Proseware", "Adatum",
                   "Woodgrove", "Lucerne", "Wingtip", "Coho", "Alpine", "Trey"]
SUPPLIER_NAME_B = ["Components", "Packaging", "Metals", "Chemicals", "Logistics", "Services", "Plastics"]
SUPPLIER_CATEGORY = ["Direct Materials", "Packaging", "Logistics & Freight", "MRO & Supplies",
                     "Professional Services", "IT & Software", "Utilities"]
CUSTOMER_SALT = "cust"
SUPPLIER_SALT = "supp"
# -------------------------------------------------------------------------

RATE = "decimal(10,6)"


def _pick(words: list[str], rn: Column) -> Column:
    """0-based pick ``words[rn % len(words)]``."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (rn % len(words) + 1).cast("int"))


def partner_ids(journal: DataFrame, col: str) -> DataFrame:
    return journal.filter(F.col(col) != "").select(F.col(col).alias("partner_id")).distinct()


def dim_customer(journal: DataFrame) -> DataFrame:
    return customer_rows(dense_index(partner_ids(journal, "customer"), "partner_id", "rn"))


def customer_rows(ids: DataFrame) -> DataFrame:
    """Customers from ``(partner_id, rn)``."""
    h = F.col("h")
    h10 = h % 10
    return (ids.withColumn("h", bucket100("partner_id", F.lit(CUSTOMER_SALT)))
            .select(
                F.col("partner_id").alias("customer_id"),
                F.concat_ws(" ", _pick(CUSTOMER_NAME_A, F.col("rn")), _pick(CUSTOMER_NAME_B, F.col("rn")))
                .alias("customer_name"),
                F.when(h < 35, "Enterprise").when(h < 75, "Mid-Market").otherwise("Distributor").alias("segment"),
                F.when(h % 3 == 0, "NT30").when(h % 3 == 1, "NT45").otherwise("NT60").alias("payment_terms"),
                F.when(h % 3 == 0, 30).when(h % 3 == 1, 45).otherwise(60).alias("terms_days"),
                F.when(h10 < 5, h % 5 - 6)
                 .when(h10 < 8, 4 + h % 8)
                 .when(h10 == 8, 20 + h % 11)
                 .otherwise(35 + h % 16).cast("int").alias("avg_delay_days"),
                F.when(h10 < 5, "Low").when(h10 < 8, "Medium").otherwise("High").alias("credit_risk"),
                ((5 + h % 20) * 50000).cast("bigint").alias("credit_limit_usd"),
                F.lit(True).alias("is_demo_enrichment"),
            ))


def dim_supplier(journal: DataFrame) -> DataFrame:
    return supplier_rows(dense_index(partner_ids(journal, "supplier"), "partner_id", "rn"))


def supplier_rows(ids: DataFrame) -> DataFrame:
    """Suppliers from ``(partner_id, rn)``."""
    h = F.col("h")
    std = h.between(55, 74)
    return (ids.withColumn("h", bucket100("partner_id", F.lit(SUPPLIER_SALT)))
            .select(
                F.col("partner_id").alias("supplier_id"),
                F.concat_ws(" ", _pick(SUPPLIER_NAME_A, F.col("rn")), _pick(SUPPLIER_NAME_B, F.col("rn")))
                .alias("supplier_name"),
                _pick(SUPPLIER_CATEGORY, F.col("rn")).alias("category"),
                F.when(h < 30, "Dynamic Discounting").when(h < 55, "Supply Chain Finance")
                 .otherwise("Standard").alias("early_pay_program"),
                F.when(h < 30, "NT45").when(h < 55, "NT90").when(h < 75, "2/10 NET30")
                 .when(h % 2 == 0, "NT30").otherwise("NT60").alias("payment_terms"),
                F.when(h < 30, 45).when(h < 55, 90).when(h < 75, 30)
                 .when(h % 2 == 0, 30).otherwise(60).alias("terms_days"),
                F.when(std, F.lit("0.02")).otherwise(F.lit("0")).cast(RATE).alias("static_discount_pct"),
                F.when(std, 10).otherwise(0).alias("static_discount_days"),
                F.when(h < 30, F.lit(0.08).cast(RATE) + (h % 5).cast(RATE) * F.lit(0.01).cast(RATE))
                 .cast(RATE).alias("dd_apr"),
                F.when(h.between(30, 54), F.lit(0.055).cast(RATE) + (h % 4).cast(RATE) * F.lit(0.005).cast(RATE))
                 .cast(RATE).alias("scf_funding_rate"),
                F.when(h % 10 < 6, "Strategic").when(h % 10 < 9, "Core").otherwise("Tail").alias("supplier_segment"),
                F.lit(True).alias("is_demo_enrichment"),
            ))
