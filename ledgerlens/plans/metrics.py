"""Declarative metric layer over the curated tables.

A metric is an aggregate SQL expression over one logical table; a dimension
is a column of that table reachable by its name or a synonym; facts are
column aliases usable in filters.  ``metric_query`` resolves names, checks
that all metrics and dimensions come from one logical table (the layer
declares no relationships), and builds a single ``groupBy().agg()``:
Catalyst sees an ordinary aggregation and plans partial aggregation,
pruning and pushdown as for hand-written code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.measures import sorted_small

TABLES = {
    "ar": "ar_items",
    "ap": "ap_items",
    "wc_kpi": "wc_monthly_kpi",
    "inventory": "inventory_monthly",
    "cash_forecast": "cash_forecast",
}

TABLE_SYNONYMS = {
    "ar": ["receivables", "accounts receivable", "customer invoices", "ar open items", "collections"],
    "ap": ["payables", "accounts payable", "supplier invoices", "vendor invoices", "ap open items"],
    "wc_kpi": ["working capital", "kpis", "cash conversion cycle", "monthly kpis"],
    "inventory": ["inventory", "stock"],
    "cash_forecast": ["cash forecast", "13 week forecast", "liquidity forecast"],
}


# ---- fixed values (must equal the model being reproduced): metrics,
# dimensions and facts below ------------------------------------------------
def _exact_avg(col: str) -> str:
    # Mean of one-decimal day ratios: exact decimal sum, one division.
    return f"CAST(SUM(CAST({col} AS DECIMAL(18,1))) AS DOUBLE) / COUNT({col})"


# name -> (logical table, aggregate SQL expression)
METRICS: dict[str, tuple[str, str]] = {
    "total_ar": ("ar", "SUM(amount_usd)"),
    "open_ar": ("ar", "SUM(CASE WHEN is_open THEN amount_usd ELSE 0 END)"),
    "overdue_ar": ("ar", "SUM(CASE WHEN is_open AND days_past_due > 0 THEN amount_usd ELSE 0 END)"),
    "disputed_ar": ("ar", "SUM(CASE WHEN is_disputed THEN amount_usd ELSE 0 END)"),
    "ar_on_time_rate": ("ar", "AVG(CASE WHEN paid_on_time THEN 1 WHEN paid_on_time = FALSE THEN 0 END)"),
    "avg_days_to_collect": ("ar", "AVG(days_to_pay)"),
    "total_ap": ("ap", "SUM(amount_usd)"),
    "open_ap": ("ap", "SUM(CASE WHEN is_open THEN amount_usd ELSE 0 END)"),
    "total_discount_captured": ("ap", "SUM(discount_captured_usd)"),
    "total_discount_lost": ("ap", "SUM(discount_lost_usd)"),
    "total_dd_opportunity": ("ap", "SUM(dd_opportunity_usd)"),
    "total_scf_funded": ("ap", "SUM(scf_funded_usd)"),
    "ap_on_time_rate": ("ap", "AVG(CASE WHEN paid_on_time THEN 1 WHEN paid_on_time = FALSE THEN 0 END)"),
    "avg_days_to_pay_suppliers": ("ap", "AVG(days_to_pay)"),
    "avg_dso": ("wc_kpi", _exact_avg("dso")),
    "avg_dpo": ("wc_kpi", _exact_avg("dpo")),
    "avg_dio": ("wc_kpi", _exact_avg("dio")),
    "avg_ccc": ("wc_kpi", _exact_avg("ccc")),
    "total_revenue": ("wc_kpi", "SUM(revenue_usd)"),
    "total_inventory": ("inventory", "SUM(inventory_value_usd)"),
    "net_cash_flow": ("cash_forecast",
                      "SUM(ar_receipts_usd - ap_payments_usd - payroll_usd - other_opex_usd)"),
}


@dataclass(frozen=True)
class Dim:
    table: str
    column: str
    synonyms: tuple[str, ...] = field(default_factory=tuple)
    # Small domain (companies, buckets, flags, the 91 names, months): a
    # grouped result fits one sorting task.  Days grow with the history.
    small: bool = True


# logical dimension name -> column (+ synonyms)
DIMENSIONS: dict[str, Dim] = {
    "ar_company": Dim("ar", "company", ("company", "entity", "company code")),
    "customer_name": Dim("ar", "customer_name", ("customer", "client")),
    "customer_segment": Dim("ar", "segment"),
    "credit_risk": Dim("ar", "credit_risk"),
    "ar_aging_bucket": Dim("ar", "aging_bucket", ("aging", "ageing bucket")),
    "ar_is_open": Dim("ar", "is_open"),
    "is_disputed": Dim("ar", "is_disputed", ("dispute", "disputed")),
    "dunning_level": Dim("ar", "dunning_level"),
    "has_promise_to_pay": Dim("ar", "has_promise_to_pay", ("promise to pay",)),
    "ar_paid_on_time": Dim("ar", "paid_on_time"),
    "ar_invoice_month": Dim("ar", "invoice_month", ("month",)),
    "ar_invoice_date": Dim("ar", "invoice_date", small=False),
    "ap_company": Dim("ap", "company"),
    "supplier_name": Dim("ap", "supplier_name", ("supplier", "vendor")),
    "supplier_category": Dim("ap", "category", ("spend category",)),
    "supplier_segment": Dim("ap", "supplier_segment"),
    "early_pay_program": Dim("ap", "early_pay_program",
                             ("program", "dynamic discounting", "supply chain finance", "scf")),
    "payment_outcome": Dim("ap", "payment_outcome"),
    "ap_payment_terms": Dim("ap", "payment_terms"),
    "ap_aging_bucket": Dim("ap", "aging_bucket"),
    "ap_is_open": Dim("ap", "is_open"),
    "ap_paid_on_time": Dim("ap", "paid_on_time"),
    "paid_early_no_benefit": Dim("ap", "paid_early_no_benefit"),
    "ap_invoice_month": Dim("ap", "invoice_month"),
    "kpi_company": Dim("wc_kpi", "company"),
    "region": Dim("wc_kpi", "region"),
    "kpi_month": Dim("wc_kpi", "month", ("period", "month")),
    "month_end": Dim("wc_kpi", "month_end"),
    "inv_company": Dim("inventory", "company"),
    "inventory_category": Dim("inventory", "inventory_category"),
    "inv_month": Dim("inventory", "month"),
    "cf_company": Dim("cash_forecast", "company"),
    "week_no": Dim("cash_forecast", "week_no"),
    "week_end": Dim("cash_forecast", "week_end"),
}

# fact alias -> (logical table, column); usable in ``where``
FACTS: dict[str, tuple[str, str]] = {
    "ar_amount_usd": ("ar", "amount_usd"),
    "ar_days_past_due": ("ar", "days_past_due"),
    "ar_days_to_pay": ("ar", "days_to_pay"),
    "ap_amount_usd": ("ap", "amount_usd"),
    "ap_days_to_pay": ("ap", "days_to_pay"),
    "discount_captured_usd": ("ap", "discount_captured_usd"),
    "discount_lost_usd": ("ap", "discount_lost_usd"),
    "dd_opportunity_usd": ("ap", "dd_opportunity_usd"),
    "scf_funded_usd": ("ap", "scf_funded_usd"),
    "dso_days": ("wc_kpi", "dso"),
    "dpo_days": ("wc_kpi", "dpo"),
    "dio_days": ("wc_kpi", "dio"),
    "ccc_days": ("wc_kpi", "ccc"),
    "ar_balance": ("wc_kpi", "ar_balance_usd"),
    "ap_balance": ("wc_kpi", "ap_balance_usd"),
    "inventory_balance": ("wc_kpi", "inventory_usd"),
    "nwc": ("wc_kpi", "net_working_capital_usd"),
    "revenue": ("wc_kpi", "revenue_usd"),
    "inv_value": ("inventory", "inventory_value_usd"),
    "inv_cogs": ("inventory", "cogs_usd"),
    "receipts": ("cash_forecast", "ar_receipts_usd"),
    "payments": ("cash_forecast", "ap_payments_usd"),
    "payroll": ("cash_forecast", "payroll_usd"),
    "opex": ("cash_forecast", "other_opex_usd"),
}


def resolve_table(name: str) -> str:
    """Logical table by name or synonym."""
    n = name.strip().lower()
    if n in TABLES:
        return n
    for table, synonyms in TABLE_SYNONYMS.items():
        if n in synonyms:
            return table
    raise KeyError(f"unknown table {name!r}")


def _split(name: str) -> tuple[str | None, str]:
    """``TABLE.NAME`` or ``NAME``: the table it names, if any, and the name."""
    prefix, dot, rest = name.strip().lower().rpartition(".")
    return (resolve_table(prefix) if dot else None), rest


def resolve_dimension(name: str, table: str | None = None) -> tuple[str, Dim]:
    """Dimension by logical name or synonym, optionally as ``TABLE.NAME``; a
    synonym shared by several tables is resolved within ``table``."""
    prefix, n = _split(name)
    if n in DIMENSIONS:
        hits = [(n, DIMENSIONS[n])]
    else:
        hits = [(k, d) for k, d in DIMENSIONS.items() if n in d.synonyms or n == d.column]
    if prefix is not None:
        # a shared column of another table is not what the prefix asks for
        hits = [h for h in hits if h[1].table == prefix] or [
            (k, d) for k, d in DIMENSIONS.items() if d.table == prefix and (n in d.synonyms or n == d.column)]
        if not hits:
            raise ValueError(f"{name!r}: no such dimension in {prefix!r}")
    elif table is not None:
        hits = [h for h in hits if h[1].table == table] or hits
    if not hits:
        raise KeyError(f"unknown dimension {name!r}")
    return hits[0]


def resolve_metric(name: str) -> str:
    """Metric by name, optionally as ``TABLE.NAME``."""
    prefix, m = _split(name)
    if m not in METRICS:
        raise KeyError(f"unknown metric {name!r}")
    if prefix is not None and METRICS[m][0] != prefix:
        raise ValueError(f"metric {m!r} belongs to {METRICS[m][0]!r}, not to {prefix!r}")
    return m


def _logical(df: DataFrame, table: str) -> DataFrame:
    """``df`` under its logical table's name, with a column for each logical
    dimension, synonym and fact name that is not a column already.  A ``where``
    is resolved by Spark against these, never by replacing text; what it does
    not use is pruned."""
    names: dict[str, str] = {}
    for name, d in DIMENSIONS.items():
        if d.table == table:
            for n in (name, *d.synonyms):
                names.setdefault(n, d.column)
    for name, (t, column) in FACTS.items():
        if t == table:
            names.setdefault(name, column)
    have = {c.lower() for c in df.columns}
    more = [F.col(c).alias(n) for n, c in names.items() if n not in have]
    return df.select("*", *more).alias(table)


def metric_query(wh, metrics: list[str], dimensions: list[str] | None = None, where: str | None = None) -> DataFrame:
    """METRICS m1, m2 DIMENSIONS d1, d2 [WHERE sql] as one aggregation.

    ``where`` may use columns, logical dimensions, synonyms (in backticks if
    they have spaces) and facts of the table, with or without its name."""
    ms = [resolve_metric(m) for m in metrics]
    tables = {METRICS[m][0] for m in ms}
    if len(tables) != 1:
        raise ValueError(f"metrics span several logical tables: {sorted(tables)}")
    table = tables.pop()
    dims = [resolve_dimension(d, table) for d in (dimensions or [])]
    for name, d in dims:
        if d.table != table:
            raise ValueError(f"dimension {name!r} belongs to {d.table!r}, metrics to {table!r}")
    df = getattr(wh, TABLES[table])
    if where:
        columns = df.columns
        df = _logical(df, table).filter(F.expr(where)).select(*columns)
    aggs = [F.expr(METRICS[m][1]).alias(m) for m in ms]
    keys = [F.col(d.column).alias(name) for name, d in dims]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    if not keys:
        return out
    names = [name for name, _ in dims]
    if len(dims) == 1 and dims[0][1].small:
        return out.transform(sorted_small(*names))
    # Several dimensions multiply, and days grow with the history: a
    # distributed range sort instead of one task.
    return out.orderBy(*names)

