"""Run the streaming refresh over a warehouse's journal and read the results.

Used by the registered ``stream_*`` queries and the tests: the journal's own
files are streamed to completion with ``availableNow``, and the read side
returns the same tables the batch pipeline builds.
"""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import DataFrame

from ledgerlens.streaming import refresh

_LOCK = threading.RLock()


class StreamRun:
    def __init__(self, wh, files_per_trigger: int = refresh.FILES_PER_TRIGGER, seed: bool = True):
        """``seed``: start from the warehouse's partner tables, so that the
        partners have the numbers (and names) of the batch build."""
        self.wh = wh
        self.files_per_trigger = files_per_trigger
        self.seed = seed
        self.root = os.path.join(wh.root, "stream-" + uuid.uuid4().hex[:8])
        self.refresh = refresh.Refresh(wh.spark, self.root, wh.params, wh.dim_company)
        self._done = False

    def run(self) -> "StreamRun":
        with _LOCK:
            if not self._done:
                wh = self.wh
                wh.journal  # written, or in place already
                source = wh.journal_path or wh.path("journal")
                none = wh.spark.createDataFrame
                if self.seed:
                    self.refresh.seed(wh.dim_customer, wh.dim_supplier)
                else:
                    self.refresh.seed(none([], wh.dim_customer.schema), none([], wh.dim_supplier.schema))
                refresh.start(self.refresh, source, os.path.join(self.root, "checkpoint"),
                              files_per_trigger=self.files_per_trigger).awaitTermination()
                self._done = True
            return self

    def ar_items(self) -> DataFrame:
        return self.refresh.items("ar")

    def ap_items(self) -> DataFrame:
        return self.refresh.items("ap")

    def monthly_flows(self) -> DataFrame:
        return self.refresh.flows()

    def wc_monthly_kpi(self) -> DataFrame:
        return self.refresh.table("kpi")

    def inventory_monthly(self) -> DataFrame:
        return self.refresh.table("inventory")

    def cash_forecast(self) -> DataFrame:
        return self.refresh.table("forecast")


_RUNS: dict[int, StreamRun] = {}


def stream_run(wh) -> StreamRun:
    with _LOCK:
        if id(wh) not in _RUNS:
            _RUNS[id(wh)] = StreamRun(wh)
        return _RUNS[id(wh)].run()
