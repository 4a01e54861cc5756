"""Incremental refresh with Structured Streaming.

New journal files arrive in a folder; one streaming query keeps the curated
tables current.  Each micro-batch (``foreachBatch``) does, in order:

1. partners: ids not seen before get the next numbers and join the partner
   tables, so no line is ever lost to a dimension that is behind;
2. items: AR and AP core items of the batch (hot partners split off as in a
   batch build).  As-of dependent columns are not stored; the read side applies
   ``ar_status``/``ap_status`` for the as-of date asked for;
3. running totals: flow and balance deltas per (company, month end), and what
   is due per (company, invoice date, expected date).  Both are additive, so a
   batch adds its own to the totals of the one before.  Their size follows the
   calendar (companies x months, companies x days x terms), not the items;
4. monthly tables and the forecast, from those totals alone.

No batch reads the items of earlier ones.  What grows with the stream is the
partner lookup of step 1 (with the partners) and the one listing of versions.

Versions: a batch writes each table to a fresh folder (``batch_id=N/attempt=X``)
and publishes all of them at once by renaming a small file to
``_versions/N.json``.  Readers go by those files, so they see the tables of a
batch all or not at all, and keep the old ones while a batch is written or
after it broke off.  A batch that is replayed after it was published does
nothing; one replayed before that writes a new attempt.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.config import Params
from ledgerlens.operators.dense_index import dense_index
from ledgerlens.plans import cash, dims, items, kpi
from ledgerlens.plans import flows as flow_plan
from ledgerlens.sources.journal import JOURNAL_SCHEMA

# Files of one micro-batch; bounds its size by the file size of the journal.
FILES_PER_TRIGGER = 256
SEED = -1  # batch id of the partner tables that a stream starts with
WHOLE = ("deltas", "due", "inventory", "kpi", "forecast")  # each version holds all rows


def journal_stream(spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    return (spark.readStream.schema(JOURNAL_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
                 .parquet(folder))


class Refresh:
    """The tables of one stream under ``root`` and what a micro-batch does."""

    def __init__(self, spark: SparkSession, root: str, params: Params, dim_company: DataFrame):
        self.spark, self.root, self.params, self.dim_company = spark, root, params, dim_company
        self._seen: dict[int, dict[str, list]] = {}

    # ---- storage ---------------------------------------------------------
    def _path(self, name: str, batch_id: int | None = None) -> str:
        path = os.path.join(self.root, name)
        return path if batch_id is None else os.path.join(path, f"batch_id={batch_id}")

    def _fs(self):
        return self._hadoop(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> dict[int, dict[str, list]]:
        """Published batches: ``{batch_id: {table: [folder, rows]}}``.  A file
        is read once; it never changes."""
        folder = self._hadoop(self._path("_versions"))
        fs = self._fs()
        if fs.exists(folder):
            for entry in fs.listStatus(folder):
                name = entry.getPath().getName()
                if name.endswith(".json") and int(name[:-5]) not in self._seen:
                    stream = fs.open(entry.getPath())
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                    stream.close()
                    self._seen[int(name[:-5])] = json.loads(text)
        return dict(sorted(self._seen.items()))

    def _publish(self, batch_id: int, tables: dict[str, list]) -> None:
        fs, folder = self._fs(), self._path("_versions")
        fs.mkdirs(self._hadoop(folder))
        draft = self._hadoop(os.path.join(folder, f".{batch_id}-{uuid.uuid4().hex}"))
        out = fs.create(draft)
        out.write(bytearray(json.dumps(tables), "utf-8"))
        out.close()
        if not fs.rename(draft, self._hadoop(os.path.join(folder, f"{batch_id}.json"))):
            raise RuntimeError(f"batch {batch_id} is published already")

    def _put(self, df: DataFrame, name: str, batch_id: int, tables: dict[str, list]) -> DataFrame:
        """``df`` written to a fresh folder, noted in ``tables``, and read back."""
        folder = f"{name}/batch_id={batch_id}/attempt={uuid.uuid4().hex[:8]}"
        df.write.parquet(os.path.join(self.root, folder))
        stored = self._read([folder])
        tables[name] = [folder, stored.count()]
        return stored

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[os.path.join(self.root, f) for f in folders])

    def _upto(self, name: str, batch_id: int | None = None) -> DataFrame:
        """All rows of the published batches up to ``batch_id``."""
        found = [v[name] for i, v in self.versions().items() if name in v and (batch_id is None or i <= batch_id)]
        if not found:
            raise LookupError(f"no batch of {name} is published")
        return self._read([folder for folder, rows in found if rows] or [found[-1][0]])

    def _last(self, name: str, before: int | None = None) -> DataFrame | None:
        """The last published version (of the batches under ``before``)."""
        found = [v[name][0] for i, v in self.versions().items() if name in v and (before is None or i < before)]
        return self._read(found[-1:]) if found else None

    def expire(self, keep: int = 48) -> None:
        """Delete the whole versions (``WHOLE``) before the last ``keep`` ones,
        and the unpublished attempts of published batches.  Items, partners and
        the files of ``versions`` stay."""
        fs, known = self._fs(), self.versions()
        kept = {folder for i, (b, v) in enumerate(known.items()) for n, (folder, _) in v.items()
                if n not in WHOLE or i >= len(known) - keep}
        for batch_id, tables in known.items():
            for name in tables:
                folder = self._hadoop(self._path(name, batch_id))
                for attempt in fs.listStatus(folder) if fs.exists(folder) else []:
                    here = f"{name}/batch_id={batch_id}/{attempt.getPath().getName()}"
                    if here not in kept:
                        fs.delete(attempt.getPath(), True)

    # ---- one micro-batch -------------------------------------------------
    def seed(self, dim_customer: DataFrame, dim_supplier: DataFrame) -> None:
        """The partners to start with, if a full build has numbered them."""
        tables: dict[str, list] = {}
        self._put(dim_customer, "dim_customer", SEED, tables)
        self._put(dim_supplier, "dim_supplier", SEED, tables)
        self._publish(SEED, tables)

    def _partners(self, batch: DataFrame, batch_id: int, kind: str, rows: Callable[[DataFrame], DataFrame],
                  tables: dict[str, list]) -> DataFrame:
        """The partner table after this batch."""
        name, key = f"dim_{kind}", f"{kind}_id"
        ids = dims.partner_ids(batch, kind)
        known = self._upto(name, batch_id - 1)
        numbers = sum(v[name][1] for i, v in self.versions().items() if name in v and i < batch_id)
        fresh = ids.join(known.select(F.col(key).alias("partner_id")), "partner_id", "left_anti")
        numbered = dense_index(fresh, "partner_id", "rn").withColumn("rn", F.col("rn") + numbers)
        return known.unionByName(self._put(rows(numbered), name, batch_id, tables))

    def _add(self, part: DataFrame, name: str, batch_id: int, keys: list[str], tables: dict[str, list]) -> DataFrame:
        """The running total ``name`` with ``part`` added: sums, and the
        greatest of the flag ``spine``."""
        before = self._last(name, batch_id)
        rows = part if before is None else before.unionByName(part)
        total = [(F.max(c) if c == "spine" else F.sum(c)).cast(rows.schema[c].dataType).alias(c)
                 for c in rows.columns if c not in keys]
        return self._put(rows.groupBy(*keys).agg(*total), name, batch_id, tables)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.versions():
            return
        p, done = self.params, {}
        customers = self._partners(batch, batch_id, "customer", dims.customer_rows, done)
        suppliers = self._partners(batch, batch_id, "supplier", dims.supplier_rows, done)
        how = {"split_hot": True, "even": True}
        ar = self._put(items.ar_core(batch, customers, self.dim_company, **how), "ar", batch_id, done)
        ap = self._put(items.ap_core(batch, suppliers, self.dim_company, **how), "ap", batch_id, done)
        deltas = self._add(flow_plan.monthly_deltas(ar, ap, p.history_start), "deltas", batch_id,
                           ["company_code", "month_end"], done)
        due = self._add(cash.due_parts(ar, ap), "due", batch_id, cash.DUE_KEYS, done)

        flows = flow_plan.flows_from_deltas(deltas, p.as_of)
        inventory = self._put(kpi.inventory_monthly(flows, self.dim_company), "inventory", batch_id, done)
        self._put(kpi.wc_monthly_kpi(flows, inventory, self.dim_company, p.kpi_start), "kpi", batch_id, done)
        self._put(cash.cash_forecast(self.spark, p, *cash.open_parts(due, p.as_of), flows, self.dim_company),
                  "forecast", batch_id, done)
        self._publish(batch_id, done)

    # ---- the read side ---------------------------------------------------
    def items(self, kind: str, batch_id: int | None = None) -> DataFrame:
        core = self._upto(kind, batch_id)
        return (items.ar_status if kind == "ar" else items.ap_status)(core, self.params.as_of)

    def flows(self) -> DataFrame:
        """Running balances on the spine's months, from the totals of the last
        micro-batch."""
        return flow_plan.flows_from_deltas(self._last("deltas"), self.params.as_of)

    def table(self, name: str) -> DataFrame:
        """``inventory``, ``kpi`` or ``forecast`` as of the last micro-batch."""
        return self._last(name)


def start(refresh: Refresh, source: str, checkpoint: str, available_now: bool = True,
          files_per_trigger: int = FILES_PER_TRIGGER):
    """Start the streaming query over the journal files in ``source``."""
    w = (journal_stream(refresh.spark, source, files_per_trigger).writeStream.foreachBatch(refresh)
         .option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 day")).start()
