"""Streaming refresh equals the batch tables after several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import EARLY_AS_OF, TEST_PARAMS
from ledgerlens.plans.lineage import lineage_counts, lineage_products
from ledgerlens.plans.warehouse import Warehouse
from ledgerlens.streaming.runner import StreamRun


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    return a.select(cols).exceptAll(b.select(cols)).count() == 0 and b.select(cols).exceptAll(a.select(cols)).count() == 0


@pytest.fixture(scope="module")
def files(spark, wh, tmp_path_factory):
    """The journal as a table of several files in posting order."""
    path = str(tmp_path_factory.mktemp("journal"))
    (wh.journal.repartitionByRange(3, "posting_date").write.mode("overwrite").parquet(path))
    return path


def test_stream_equals_batch(spark, wh, files):
    own = Warehouse(spark, journal_path=files, params=TEST_PARAMS)
    run = StreamRun(own, files_per_trigger=1).run()
    for name in ("ar_items", "ap_items", "monthly_flows", "wc_monthly_kpi", "inventory_monthly", "cash_forecast"):
        assert _same(getattr(run, name)(), getattr(wh, name)), name
    batches = spark.read.parquet(run.refresh._path("deltas")).select("batch_id").distinct().count()
    assert batches == 3

    # a replayed batch leaves the same state
    names = sorted(r[0] for r in spark.read.parquet(files).select(F.input_file_name()).distinct().collect())
    flows = run.monthly_flows().collect()
    seen = {r[0] for r in spark.read.parquet(run.refresh._path("ar", 2)).select("document_id").collect()}
    for name in names:
        batch = spark.read.schema(own.journal.schema).parquet(name)
        if seen & {r[0] for r in batch.select("accounting_document").collect()}:  # the file that was batch 2
            run.refresh(batch, 2)
    assert sorted(run.monthly_flows().collect()) == sorted(flows)
    assert _same(run.ar_items(), wh.ar_items) and _same(run.cash_forecast(), wh.cash_forecast)


def test_a_broken_batch_leaves_the_published_tables(spark, wh, files, monkeypatch):
    """Readers keep the last published batch while another one is written or
    breaks off; the batch's second attempt ends in the batch result.  No batch
    reads the items of the others."""
    own = Warehouse(spark, journal_path=files, params=TEST_PARAMS)
    run = StreamRun(own, files_per_trigger=1)
    run.refresh.seed(wh.dim_customer, wh.dim_supplier)
    names = sorted(r[0] for r in spark.read.parquet(files).select(F.input_file_name()).distinct().collect())
    batches = [spark.read.schema(own.journal.schema).parquet(n) for n in names]
    run.refresh(batches[0], 0)
    before = {t: run.refresh.table(t).collect() for t in ("kpi", "forecast")}
    items = run.ar_items().count()

    def broken(*args):
        assert {t: run.refresh.table(t).collect() for t in before} == before  # a reader in between
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr("ledgerlens.streaming.refresh.cash.cash_forecast", broken)
        with pytest.raises(OSError):
            run.refresh(batches[1], 1)
    assert {t: run.refresh.table(t).collect() for t in before} == before and run.ar_items().count() == items

    read = []
    plain = run.refresh._read
    monkeypatch.setattr(run.refresh, "_read", lambda folders: read.append(folders) or plain(folders))
    for i, batch in enumerate(batches[1:], 1):
        run.refresh(batch, i)
    for name in ("ar", "ap"):
        assert all(len(f) == 1 for f in read if f[0].startswith(name + "/"))
    monkeypatch.undo()
    # another reader, with nothing but the folder
    again = StreamRun(own)
    again.refresh.root = run.refresh.root
    for name in ("ar_items", "ap_items", "monthly_flows", "wc_monthly_kpi", "inventory_monthly", "cash_forecast"):
        assert _same(getattr(again, name)(), getattr(wh, name)), name

    run.refresh.expire(keep=1)
    left = spark.read.parquet(run.refresh._path("kpi")).select("batch_id").distinct().count()
    assert left == 1 and _same(run.cash_forecast(), wh.cash_forecast) and _same(run.ar_items(), wh.ar_items)


def test_due_parts_at_another_day(spark, wh):
    from ledgerlens.plans import cash, items
    due = cash.due_parts(wh.ar_core, wh.ap_core)
    for frame, day, core, status in zip(cash.open_parts(due, EARLY_AS_OF),
                                        ("expected_clearing_date", "expected_payment_date"),
                                        (wh.ar_core, wh.ap_core), (items.ar_status, items.ap_status)):
        key = ["company_code", day]
        want = status(core, EARLY_AS_OF).filter("is_open").groupBy(*key).agg(F.sum("amount_usd").alias("amount"))
        got = frame.groupBy(*key).agg(F.sum("amount_usd").alias("amount"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_new_partners_lose_no_line(spark, wh, files):
    """Without known partners, each batch numbers the ones it meets first."""
    run = StreamRun(Warehouse(spark, journal_path=files, params=TEST_PARAMS), files_per_trigger=1, seed=False).run()
    assert run.ar_items().count() == wh.ar_items.count() and run.ap_items().count() == wh.ap_items.count()
    for name, key in (("dim_customer", "customer_id"), ("dim_supplier", "supplier_id")):
        got = run.refresh._upto(name)
        assert got.count() == got.select(key).distinct().count() == getattr(wh, name).count()


def test_journal_path_warehouse(spark, wh, files):
    """The production path: as-of views at any date, and lineage."""
    own = Warehouse(spark, journal_path=files, params=TEST_PARAMS.with_(as_of=EARLY_AS_OF))
    late = own.ar_items.filter(F.col("invoice_date") > F.lit(EARLY_AS_OF)).count()
    assert late == 0 and own.ar_items.count() < wh.ar_items.count() <= own.ar_core.count()
    last = own.monthly_flows.agg(F.max("month_end")).first()[0]
    assert last == dt.date(1999, 12, 31) == own.wc_monthly_kpi.agg(F.max("month_end")).first()[0]
    # lineage counts what the warehouse was given
    row = lineage_counts(own).first().asDict()
    assert set(row) == {"acctg", "dt_ar", "dt_ap"} and row["acctg"] == own.journal.count()
    assert lineage_products(own).count() == 1
