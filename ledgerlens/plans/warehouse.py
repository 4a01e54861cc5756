"""The curated tables as one lazily built, optionally materialised set.

Dependency order: journal -> partner dims -> AR/AP core items -> monthly
flows -> inventory -> KPIs -> {forecast, levers}; bank balances stand
alone.  Tables that feed several consumers (the journal derived from the
test tables, dims, item cores, flows, inventory, KPI, forecast) are written
as parquet under the shared
checkpoint folder (``spark.checkpoint.dir``) and read back, which cuts
lineage, survives executor loss, and lets every dashboard query scan a
pruned, pushed-down file set instead of re-running the pipeline.  The item
tables are written partitioned by invoice month, so period filters (the
dashboards' month range) prune whole directories.  The monthly tables are
bounded by companies x months and are also cached in memory.
"""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.config import TEST_PARAMS, Params
from ledgerlens.operators.skew_join import is_small
from ledgerlens.plans import cash, dims, flows, items, kpi, levers, state_calendar
from ledgerlens.session import ensure_checkpoint_dir
from ledgerlens.sources import literals
from ledgerlens.sources.journal import journal_from_tpch, read_journal

_LOCK = threading.RLock()
_CACHE: dict[tuple, "Warehouse"] = {}

# Writes: table name -> partition columns
_LAYOUT = {
    "journal": [],
    "dim_customer": [],
    "dim_supplier": [],
    "ar_core": ["invoice_month"],
    "ap_core": ["invoice_month"],
    "monthly_flows": [],
    "ap_parts": [],
    "ar_parts": [],
    "ar_calendar": [],
    "ap_calendar": [],
    "inventory_monthly": [],
    "wc_monthly_kpi": [],
    "cash_forecast": [],
    "wc_opportunities": [],
}

# Partitioned tables: column the rows of each month are sorted on when
# written.  The as-of view's ``is_open`` is pushed to the scan as
# ``expected_* > as_of``; with the rows clustered on that date, parquet
# row-group min/max statistics let open-item scans skip the cleared rows.
_CLUSTER = {"ar_core": "expected_clearing_date", "ap_core": "expected_payment_date"}

# Tables whose size is bounded by companies x months (x categories or
# weeks), not by the number of journal lines: kept in memory after being
# written, as every dashboard query reads one of them.  Lost blocks are
# re-read from the written files.
_SMALL = {"ap_parts", "ar_parts", "monthly_flows", "inventory_monthly", "wc_monthly_kpi", "cash_forecast", "wc_opportunities"}


def layout(name: str, df: DataFrame, rebalance: bool = True) -> DataFrame:
    """The frame as it is written for table ``name``.

    Partitioned tables are rebalanced on the partition columns first (unless
    ``items.by_date`` dealt their lines out already): without it every task
    writes one file per month it holds (tasks x months small files).  AQE sizes
    the rebalance partitions to the advisory size and splits a month larger
    than that, so a hot month does not end up in one task.  The writer sorts
    each task on the partition columns anyway; the cluster key rides on that
    sort.
    """
    parts = _LAYOUT.get(name) or []
    if not parts:
        return df
    out = df.hint("rebalance", *parts) if rebalance else df
    if name in _CLUSTER:
        out = out.sortWithinPartitions(*parts, _CLUSTER[name])
    return out


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str | None = None, params: Params = TEST_PARAMS,
                 journal_path: str | None = None, materialize: bool = True, root: str | None = None,
                 companies: DataFrame | None = None):
        """``companies``: the company dimension where companies are data, with
        the columns of ``literals.dim_company``; else the literal one."""
        if sf_dir is None and journal_path is None:
            raise ValueError("need sf_dir (test tables) or journal_path (journal table)")
        self.spark, self.sf_dir, self.params = spark, sf_dir, params
        self.journal_path = journal_path
        self.materialize = materialize
        self.companies = companies
        base = root or os.path.join(ensure_checkpoint_dir(spark), "ledgerlens-gold")
        self.root = os.path.join(base, uuid.uuid4().hex[:12])
        self._tables: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    # ---- plumbing ------------------------------------------------------
    def _get(self, name: str, build, write: bool = True, rebalance: bool = True) -> DataFrame:
        # One lock per table: independent tables can be built by concurrent
        # jobs; a table is never built twice.  The dependency graph is
        # acyclic, so nested acquisition cannot deadlock.
        with self._guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            if name in self._tables:
                return self._tables[name]
            df = build()
            if write and self.materialize and name in _LAYOUT:
                path = os.path.join(self.root, name)
                w = layout(name, df, rebalance).write.mode("overwrite")
                if _LAYOUT[name]:
                    w = w.partitionBy(*_LAYOUT[name])
                w.parquet(path)
                df = self.spark.read.parquet(path).select(*df.columns)
                if name in _SMALL:
                    df = df.cache()
            self._tables[name] = df
            return df

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    # ---- literal dimensions ---------------------------------------------
    @property
    def dim_company(self) -> DataFrame:
        return literals.dim_company(self.spark) if self.companies is None else self.companies

    @property
    def dim_inventory_category(self) -> DataFrame:
        return literals.dim_inventory_category(self.spark)

    @property
    def dim_bank_account(self) -> DataFrame:
        return literals.dim_bank_account(self.spark)

    # ---- pipeline -------------------------------------------------------
    @property
    def journal(self) -> DataFrame:
        # An existing journal table is already files: it is read in place, not
        # copied.  Only the journal derived from the test tables is written.
        if self.journal_path:
            return self._get("journal", lambda: read_journal(self.spark, self.journal_path), write=False)
        return self._get("journal", lambda: journal_from_tpch(self.spark, self.sf_dir))

    @property
    def dim_customer(self) -> DataFrame:
        return self._get("dim_customer", lambda: dims.dim_customer(self.journal))

    @property
    def dim_supplier(self) -> DataFrame:
        return self._get("dim_supplier", lambda: dims.dim_supplier(self.journal))

    def _core(self, name: str, build, dim: DataFrame) -> DataFrame:
        """Lines are dealt out before a partner join that leaves them in their
        tasks (the partners are broadcast); after a shuffle join the wide rows
        are rebalanced."""
        early = name not in self._tables and self.materialize and is_small(dim)
        return self._get(name, lambda: build(self.journal, dim, self.dim_company, spread=early), rebalance=not early)

    @property
    def ar_core(self) -> DataFrame:
        return self._core("ar_core", items.ar_core, self.dim_customer)

    @property
    def ap_core(self) -> DataFrame:
        return self._core("ap_core", items.ap_core, self.dim_supplier)

    @property
    def ar_items(self) -> DataFrame:
        return self._get("ar_items", lambda: items.ar_status(self.ar_core, self.params.as_of))

    @property
    def ap_items(self) -> DataFrame:
        return self._get("ap_items", lambda: items.ap_status(self.ap_core, self.params.as_of))

    @property
    def ar_parts(self) -> DataFrame:
        """AR rollup by (segment, aging bucket, dunning level, open flag)."""
        return self._get("ar_parts", lambda: items.ar_status_parts(self.ar_items))

    @property
    def ap_parts(self) -> DataFrame:
        """AP rollup by (program, outcome, open flag): a few dozen rows."""
        return self._get("ap_parts", lambda: items.ap_outcome_parts(self.ap_items))

    @property
    def ar_calendar(self) -> DataFrame:
        """Dated changes of the open AR items, for any day's aging."""
        return self._get("ar_calendar", lambda: state_calendar.state_deltas(self.ar_core, "ar"))

    @property
    def ap_calendar(self) -> DataFrame:
        """Dated changes of the open AP items, for any day's aging."""
        return self._get("ap_calendar", lambda: state_calendar.state_deltas(self.ap_core, "ap"))

    @property
    def monthly_flows(self) -> DataFrame:
        return self._get("monthly_flows",
                         lambda: flows.monthly_flows(self.ar_core, self.ap_core, self.params.history_start,
                                                     self.params.as_of))

    @property
    def inventory_monthly(self) -> DataFrame:
        return self._get("inventory_monthly", lambda: kpi.inventory_monthly(self.monthly_flows, self.dim_company))

    @property
    def wc_monthly_kpi(self) -> DataFrame:
        return self._get("wc_monthly_kpi", lambda: kpi.wc_monthly_kpi(
            self.monthly_flows, self.inventory_monthly, self.dim_company, self.params.kpi_start))

    @property
    def bank_balance_weekly(self) -> DataFrame:
        return self._get("bank_balance_weekly",
                         lambda: cash.bank_balance_weekly(self.spark, self.params, self.dim_company))

    @property
    def cash_forecast(self) -> DataFrame:
        return self._get("cash_forecast", lambda: cash.cash_forecast(
            self.spark, self.params, self.ar_items, self.ap_items, self.monthly_flows, self.dim_company))

    @property
    def wc_opportunities(self) -> DataFrame:
        return self._get("wc_opportunities", lambda: levers.wc_opportunities(
            self.wc_monthly_kpi, self.monthly_flows, self.inventory_monthly, self.ap_items, self.params))

    # Build order; tables on one level do not depend on each other.
    LEVELS = [["journal"], ["dim_customer", "dim_supplier"], ["ar_core", "ap_core"], ["monthly_flows", "ar_parts", "ap_parts"],
              ["inventory_monthly"], ["wc_monthly_kpi", "cash_forecast"], ["wc_opportunities"]]

    def build_all(self, parallel: bool = True) -> dict[str, DataFrame]:
        """Materialise every curated table; with ``parallel`` the tables of one
        level are submitted as concurrent Spark jobs (the scheduler shares the
        executors between them)."""
        from concurrent.futures import ThreadPoolExecutor
        for level in self.LEVELS:
            if parallel and len(level) > 1:
                with ThreadPoolExecutor(max_workers=len(level)) as ex:
                    list(ex.map(lambda n: getattr(self, n), level))
            else:
                for n in level:
                    getattr(self, n)
        names = [n for lv in self.LEVELS for n in lv] + ["bank_balance_weekly", "ar_items", "ap_items"]
        return {n: getattr(self, n) for n in names}


def get_warehouse(spark: SparkSession, sf_dir: str, params: Params = TEST_PARAMS, materialize: bool = True) -> Warehouse:
    """One warehouse per (session, data folder, parameters)."""
    key = (id(spark), spark.sparkContext.applicationId, os.path.abspath(sf_dir), params, materialize)
    with _LOCK:
        wh = _CACHE.get(key)
        if wh is None:
            wh = Warehouse(spark, sf_dir, params, materialize=materialize)
            _CACHE[key] = wh
        return wh
