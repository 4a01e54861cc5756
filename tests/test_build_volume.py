"""What the shared build moves and emits: lines are shuffled once and narrow,
events follow the months, not the items."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import skew_join
from ledgerlens.operators.skew_join import split_join
from ledgerlens.plans import flows, items
from ledgerlens.sources.journal import JOURNAL_SCHEMA, journal_from_tpch


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, folder, lines: int) -> str:
    day = F.timestamp_seconds(F.lit(900_000_000) + F.col("id") % 700 * 86400)
    made = {
        "region": spark.createDataFrame([(0, "AMERICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        "customer": spark.range(40).selectExpr("id c_custkey", "cast(id % 2 as int) c_nationkey"),
        "supplier": spark.range(10).selectExpr("id s_suppkey", "cast(id % 2 as int) s_nationkey"),
        "orders": spark.range(lines // 4).select(
            F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"),
            (F.col("id") * 1.25).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")),
        "lineitem": spark.range(lines).select(
            F.floor(F.col("id") / 4).alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
            (F.col("id") % 10).alias("l_suppkey"), (F.col("id") * 0.5).alias("l_extendedprice"), day.alias("l_shipdate"),
            F.when(F.col("id") % 5 == 0, "R").otherwise("N").alias("l_returnflag")),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_journal_is_written_without_another_shuffle(spark, tmp_path):
    journal = journal_from_tpch(spark, _tables(spark, tmp_path, 400))
    plan = _plan(journal)
    assert "RoundRobinPartitioning" not in plan and "rebalance" not in plan.lower()
    assert journal.count() == 100 + 400 + 80  # orders, line items, returned ones


def test_small_dimension_is_broadcast_and_large_one_split(spark):
    fact = spark.range(1000).select((F.col("id") % 7).alias("key"), F.col("id"))
    dim = spark.createDataFrame([(k, f"n{k}") for k in (0, 1, 2, 3, 4, 4)] + [(None, "none")], "key long, name string")
    want = sorted(map(tuple, fact.join(dim, "key").collect()))
    small, split = split_join(fact, dim, "key"), split_join(fact, dim, "key", share=0.1, small_rows=3)
    assert "Union" not in _plan(small) and "BroadcastHashJoin" in _plan(small)
    assert "Union" in _plan(split)
    assert sorted(map(tuple, small.collect())) == want == sorted(map(tuple, split.collect()))


def test_lines_are_dealt_by_date_before_the_partner_columns(spark, wh, monkeypatch):
    monkeypatch.setattr(items, "FEW_ROWS", 500)
    lines = [("1000", 2000, f"D{i}", str(i % 9), "", None if i % 50 == 0 else dt.date(2000, 1, 1) + dt.timedelta(days=i % 300),
              "USD", None, "S", "") for i in range(4000)]
    journal = spark.createDataFrame(lines, JOURNAL_SCHEMA)
    dealt = items.ar_core(journal, wh.dim_customer, wh.dim_company, spread=True)
    plain = items.ar_core(journal, wh.dim_customer, wh.dim_company)
    assert dealt.rdd.getNumPartitions() == 8
    plan = _plan(dealt)
    assert plan.index("rangepartitioning") > plan.index("BroadcastHashJoin")  # the shuffle is below the join
    assert dealt.exceptAll(plain).count() == 0 == plain.exceptAll(dealt).count()
    sizes = [n for n in dealt.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_events_follow_the_months_not_the_items(spark):
    inv, due, out = F.lit(dt.date(2000, 1, 5)), F.lit(dt.date(2000, 2, 4)), F.lit(dt.date(2000, 4, 9))
    core = spark.range(3000).select(
        F.lit("1000").alias("company_code"), F.date_add(inv, (F.col("id") % 20).cast("int")).alias("invoice_date"),
        due.alias("due_date"), out.alias("expected_clearing_date"), out.alias("expected_payment_date"),
        F.col("id").cast("decimal(18,2)").alias("amount_usd"), F.lit(1).cast("decimal(18,2)").alias("discount_captured_usd"),
        F.lit(None).cast("decimal(18,2)").alias("discount_lost_usd"))
    assert flows.ar_events(core, dt.date(2000, 1, 1)).count() == 5
    assert flows.ap_events(core).count() == 3
    total = 3000 * 2999 // 2
    rows = flows.monthly_flows(core, core, dt.date(2000, 1, 1), dt.date(2000, 6, 30)).collect()
    assert [(r.month, r.revenue_usd, r.ar_balance_usd, r.ap_balance_usd, r.discount_captured_usd, r.discount_lost_usd)
            for r in rows] == [("2000-01", total, total, total, 3000, 0)]


def test_shuffle_join_deals_the_fact_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew_join, "TASK_ROWS", 100)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fact = spark.range(100 * (least + 5)).select((F.col("id") % 5000).alias("key"), F.col("id"))
    dim = spark.range(4000).select(F.col("id").alias("key"), F.lit("n").alias("name"))
    joined = split_join(fact, dim, "key", share=0.5, small_rows=3)
    assert joined.count() == fact.join(dim, "key").count()
    assert "BroadcastHashJoin" not in _plan(joined)
    assert joined.rdd.getNumPartitions() == least + 5


def test_lines_are_counted_before_they_are_dealt(spark, wh, monkeypatch):
    """The lines of a side have partners: they are not dealt once more to look for nulls."""
    monkeypatch.setattr(skew_join, "_null_is_hot", lambda *_: 1 / 0)
    lines = [("1000", 2000, f"D{i}", str(i % 9), "", dt.date(2000, 1, 1), "USD", None, "S", "") for i in range(400)]
    lines += [("1000", 2000, f"N{i}", None, None, dt.date(2000, 1, 1), "USD", None, "S", "") for i in range(400)]
    journal = spark.createDataFrame(lines, JOURNAL_SCHEMA)
    monkeypatch.setattr(items, "FEW_ROWS", 50)
    dealt = items.ar_core(journal, wh.dim_customer, wh.dim_company, spread=True)
    even = items.ar_core(journal, wh.dim_customer, wh.dim_company, split_hot=True, even=True)
    assert dealt.exceptAll(even).count() == 0 == even.exceptAll(dealt).count()
    assert even.rdd.getNumPartitions() == 8
    sizes = even.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
