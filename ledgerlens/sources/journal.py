"""Journal-line source.

The model reads ERP journal lines: one row per accounting line with a
company code, partner (customer or supplier), posting date, signed amount
and a debit/credit code.  ``journal_from_tpch`` derives such lines from the
TPC-H-like test tables:

* every order is a customer debit line (``S``),
* every line item is a supplier credit line (``H``, negative amount),
* every returned line item (``l_returnflag = 'R'``) is also a customer
  credit memo (``H``), which the receivables extract must reject.

The company of a line is the region of the partner's nation.  All postings
are taken; the as-of views of the items leave out what was posted later.
``read_journal`` reads an existing journal table instead (the production
path); both return the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.skew_join import dealt, split_join
from ledgerlens.sources.literals import dim_company, region_company
from ledgerlens.sources.tables import read_table

JOURNAL_SCHEMA = T.StructType([
    T.StructField("company_code", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("accounting_document", T.StringType()),
    T.StructField("customer", T.StringType()),
    T.StructField("supplier", T.StringType()),
    T.StructField("posting_date", T.DateType()),
    T.StructField("currency", T.StringType()),
    T.StructField("amount_lc", T.DecimalType(18, 2)),
    T.StructField("debit_credit", T.StringType()),
    T.StructField("profit_center", T.StringType()),
])
JOURNAL_COLUMNS = [f.name for f in JOURNAL_SCHEMA.fields]

MONEY = T.DecimalType(18, 2)


def _nation_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .join(F.broadcast(region_company(spark)), "r_name")
            .select("n_nationkey", "company_code"))


def _lines(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Attach currency from the company dimension and order the columns."""
    cur = F.broadcast(dim_company(spark).select("company_code", "currency"))
    return (df.join(cur, "company_code", "left")
              .withColumn("fiscal_year", F.year("posting_date").cast("int"))
              .select(*JOURNAL_COLUMNS))


def journal_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation_company = _nation_company(spark, sf_dir)
    # partner -> company (partner keys renamed to the fact's key for the joins)
    cust_company = (read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
                    .join(nation_company, F.col("c_nationkey") == F.col("n_nationkey"))
                    .select(F.col("c_custkey").alias("o_custkey"), "company_code"))
    supp_company = (read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
                    .join(nation_company, F.col("s_nationkey") == F.col("n_nationkey"))
                    .select(F.col("s_suppkey").alias("l_suppkey"), "company_code"))

    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    lineitem = read_table(spark, sf_dir, "lineitem",
                          ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag"])

    # One customer or supplier may carry a large share of all lines: hot
    # partners are split off and joined by broadcast (operators.skew_join).
    orders_c = split_join(orders, cust_company, "o_custkey")
    ar = (orders_c
          .select(
              "company_code",
              F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("accounting_document"),
              F.col("o_custkey").cast("string").alias("customer"),
              F.lit("").alias("supplier"),
              F.col("o_orderdate").cast("date").alias("posting_date"),
              F.col("o_totalprice").cast(MONEY).alias("amount_lc"),
              F.lit("S").alias("debit_credit"),
              F.col("o_orderpriority").alias("profit_center")))

    item_doc = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    ap = (split_join(lineitem, supp_company, "l_suppkey")
          .select(
              "company_code",
              F.concat(F.lit("L"), item_doc).alias("accounting_document"),
              F.lit("").alias("customer"),
              F.col("l_suppkey").cast("string").alias("supplier"),
              F.col("l_shipdate").cast("date").alias("posting_date"),
              (-F.col("l_extendedprice").cast(MONEY)).alias("amount_lc"),
              F.lit("H").alias("debit_credit"),
              F.lit("").alias("profit_center")))

    # A returned line takes its order's customer and company: one join on the
    # order key (unique in orders, a few lines per order, so no hot key),
    # reusing the order side's customer join instead of a second one (whose
    # hot-key count would run the lineitem x orders join twice more).
    returned = lineitem.filter(F.col("l_returnflag") == "R")
    memo = (dealt(returned, max(returned.count(), orders.count()), "l_orderkey")
            .join(orders_c.select("o_orderkey", "o_custkey", "company_code"),
                  F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                "company_code",
                F.concat(F.lit("R"), item_doc).alias("accounting_document"),
                F.col("o_custkey").cast("string").alias("customer"),
                F.lit("").alias("supplier"),
                F.col("l_shipdate").cast("date").alias("posting_date"),
                (-F.col("l_extendedprice").cast(MONEY)).alias("amount_lc"),
                F.lit("H").alias("debit_credit"),
                F.lit("").alias("profit_center")))

    # Each task writes its lines as they come.  Dealing them out evenly would
    # sort every task's whole output by row hash and shuffle it once more; the
    # scans of the journal split and pack its files by size anyway.
    return _lines(ar.unionByName(ap).unionByName(memo), spark)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Read a journal table that already exists (parquet, schema enforced)."""
    return spark.read.schema(JOURNAL_SCHEMA).parquet(path).select(*JOURNAL_COLUMNS)
