"""The production path: a warehouse over an existing journal table."""

import os

from pyspark.sql import functions as F


def test_existing_journal_read_in_place(spark, wh):
    from ledgerlens.plans.warehouse import Warehouse
    src = os.path.join(wh.root, "..", "existing-journal")
    wh.journal.write.mode("overwrite").parquet(src)
    prod = Warehouse(spark, journal_path=src, params=wh.params)
    # the same items and KPIs as the warehouse built from the test tables
    assert prod.ar_items.exceptAll(wh.ar_items).count() == 0
    assert wh.ar_items.exceptAll(prod.ar_items).count() == 0
    assert prod.wc_monthly_kpi.exceptAll(wh.wc_monthly_kpi).count() == 0
    assert prod.ap_items.agg(F.sum("amount_usd")).first()[0] == wh.ap_items.agg(F.sum("amount_usd")).first()[0]
    # the journal itself is not copied into the warehouse folder
    assert not os.path.exists(prod.path("journal"))
    assert os.path.exists(prod.path("ar_core"))
