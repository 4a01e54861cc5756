"""Content digests and the copy that follows them."""

from pyspark.sql import functions as F

from ledgerlens.operators.digests import content_digests
from ledgerlens.sources import sinks


def _digest(df, part=None):
    return {r["part"]: (r["rows"], r["digest"]) for r in content_digests(df, part).collect()}


def test_digest_tells_contents_apart(spark):
    rows = [(1, "a", None), (2, None, "b"), (2, None, "b"), (None, None, None)]
    df = spark.createDataFrame(rows, "n int, x string, y string")
    same = _digest(df)
    assert same == _digest(df.repartition(3).orderBy(F.desc("n")).select("y", "n", "x"))
    others = [
        df.select("n", F.col("y").alias("x"), F.col("x").alias("y")),   # values moved to another column
        df.distinct(),                                                  # a row less
        df.distinct().unionByName(df.filter("n = 1")),                  # as many rows, another one repeated
        df.withColumn("x", F.coalesce("x", F.lit(""))),                 # empty for null
        df.withColumnRenamed("x", "z"),
    ]
    seen = [same, *(_digest(d) for d in others)]
    assert len({str(s) for s in seen}) == len(seen)
    assert _digest(df.limit(0)) == {None: (0, "0:0")}
    parts = _digest(df, "x")
    assert set(parts) == {"a", None} and sum(n for n, _ in parts.values()) == 4
    assert [sum(int(d.split(":")[i]) for _, d in parts.values()) for i in (0, 1)] == \
        [int(x) for x in same[None][1].split(":")]  # digests of parts add up


def test_sync_copies_what_differs(spark, wh, tmp_path):
    objects = ["ar_items", "dim_customer", "wc_monthly_kpi"]
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write_bundle(wh, source, objects)

    def actions():
        rows = sinks.sync_bundle(spark, source, target, objects).collect()
        return {(r["object"], r["part"]): r["action"] for r in rows if r["action"] != "same"}, len(rows)

    def equal():
        a, b = (sorted(map(tuple, sinks.bundle_digests(spark, f, objects).collect()), key=str) for f in (source, target))
        return a == b
    first, n = actions()
    assert set(first.values()) == {"copied"} and len(first) == n > len(objects) and equal()
    assert actions()[0] == {}
    back = sinks.read_object(spark, target, "ar_items").select(wh.ar_items.columns)
    assert back.exceptAll(wh.ar_items).isEmpty() and wh.ar_items.exceptAll(back).isEmpty()

    # one cell of one month, one month less, and one cell of a small table; the counts of the rest stay
    months = sorted(p for o, p in first if o == "ar_items")
    kept = sinks.read_object(spark, source, "ar_items").filter(F.col("invoice_month") != months[3])
    one = kept.filter(F.col("invoice_month") == months[1]).agg(F.min("document_id")).first()[0]
    segment = F.when(F.col("document_id") == one, F.lit(None)).otherwise(F.col("segment"))
    changed = str(tmp_path / "c")
    sinks._write(kept.withColumn("segment", segment), f"{changed}/ar_items", "invoice_month")
    name = F.when(F.col("customer_id") == wh.dim_customer.agg(F.max("customer_id")).first()[0], F.lit("x"))
    sinks._write(wh.dim_customer.withColumn("customer_name", F.coalesce(name, "customer_name")),
                 f"{changed}/dim_customer", None)
    sinks._write(wh.wc_monthly_kpi, f"{changed}/wc_monthly_kpi", None)
    source = changed
    assert actions()[0] == {("ar_items", months[1]): "copied", ("ar_items", months[3]): "removed",
                            ("dim_customer", None): "copied"}
    assert equal() and actions()[0] == {}
