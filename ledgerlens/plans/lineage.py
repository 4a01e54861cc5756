"""Lineage counts, bundle audit and self-test counts.

All three are row counts of several tables gathered into one frame.  Each
count is a global aggregate (partial counts per task, one tiny final
stage); the per-table rows are unioned so Spark runs them in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.tables import read_table

# Source objects of the lineage view in this model: the journal (L1) and
# the test tables it is derived from.  (product, source object, usage)
LINEAGE_PRODUCTS = [
    ("acctg", "Journal entry - accounting document item", "journal_line", "AR/AP open & cleared items"),
    ("billing", "Sales orders (customer invoices)", "orders", "Revenue context"),
    ("supinv", "Supplier invoice lines", "lineitem", "AP invoice context"),
    ("customers", "Customer master", "customer", "Customer partners"),
    ("suppliers", "Supplier master", "supplier", "Supplier partners"),
    ("nations", "Nation", "nation", "Company assignment"),
    ("regions", "Region", "region", "Company assignment"),
]

BUNDLE = ["wc_monthly_kpi", "ar_items", "ap_items", "inventory_monthly", "bank_balance_weekly", "cash_forecast",
          "dim_customer", "dim_supplier", "dim_company", "dim_inventory_category", "dim_bank_account",
          "wc_opportunities"]


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("object"), "rows")


def _counts(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_count(df, n) for n, df in frames.items()])


def _source_frames(wh) -> dict[str, DataFrame]:
    frames = {"acctg": wh.journal}
    # a warehouse on a journal of its own has no other source tables
    for key, _, table, _ in LINEAGE_PRODUCTS[1:] if wh.sf_dir else []:
        frames[key] = read_table(wh.spark, wh.sf_dir, table, [_first_col(table)])
    frames["dt_ar"] = wh.ar_items
    frames["dt_ap"] = wh.ap_items
    return frames


def _first_col(table: str) -> str:
    return {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "supplier": "s_suppkey",
            "nation": "n_nationkey", "region": "r_regionkey"}[table]


def lineage_counts(wh) -> DataFrame:
    """One row with a count column per source object and curated item table."""
    frames = _source_frames(wh)
    long, keys = _counts(frames), list(frames)
    return long.groupBy().pivot("object", keys).agg(F.first("rows"))


def lineage_products(wh) -> DataFrame:
    """One row per source product with its description and row count: the
    long counts joined to the (literal, seven-row) product list."""
    frames = _source_frames(wh)
    long = _counts({k: frames[k] for k, *_ in LINEAGE_PRODUCTS if k in frames})
    desc = wh.spark.createDataFrame(LINEAGE_PRODUCTS, "object string, data_product string, l1_object string, "
                                                      "usage string")
    return long.join(F.broadcast(desc), "object").select("data_product", "l1_object", "rows", "usage")


def bundle_audit(wh) -> DataFrame:
    """Row count of every bundled curated object."""
    return _counts({n: getattr(wh, n) for n in BUNDLE})


def selftest_counts(wh) -> DataFrame:
    return _counts({"ar_items": wh.ar_items, "ap_items": wh.ap_items}).select(
        "object", "rows",
        F.concat(F.lit("bundled data OK - "), F.col("object"), F.lit("="), F.col("rows").cast("string"),
                 F.lit(" rows")).alias("message"))
