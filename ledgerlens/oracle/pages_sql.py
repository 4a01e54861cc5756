"""DuckDB SQL of the dashboard pages for every company subset.

Each section is aggregated straight from the curated tables joined to the
membership of the subsets; nothing is shared with the lattice of the Spark
side."""

from __future__ import annotations

from dataclasses import dataclass, field

from ledgerlens.config import Params
from ledgerlens.sources.literals import COMPANIES

ON_TIME = "round(100.0 * count(*) FILTER (s.paid_on_time) / nullif(count(*), 0), 1)"
OVERDUE = "sum(CASE WHEN s.days_past_due > 0 THEN s.amount_usd ELSE 0 END)"


def members(p: Params) -> str:
    names = sorted(c[1] for c in COMPANIES)
    rows = []
    for mask in range(2 ** len(names)):
        own = [n for at, n in enumerate(names) if mask >> at & 1]
        key = ",".join(own) + f"||{p.period_from}..{p.period_to}"
        rows += [f"('{key}', '{n}')" for n in (own or names)]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) t(subset_key, company))"


def weighted(day: str, by: str) -> str:
    return (f"round(sum(s.{day} * CAST(s.{by} AS DOUBLE)) / nullif(sum(CASE WHEN s.{by} IS NOT NULL THEN "
            f"CAST(s.{by} AS DOUBLE) END), 0), 1)")


DSO, DPO, DIO = weighted("dso", "revenue_usd"), weighted("dpo", "purchases_usd"), weighted("dio", "cogs_usd")
CCC = f"round({DSO} + {DIO} - {DPO}, 1)"
BALANCES = {"nwc": "sum(s.net_working_capital_usd)", "ar": "sum(s.ar_balance_usd)", "ap": "sum(s.ap_balance_usd)",
            "inventory": "sum(s.inventory_usd)"}


@dataclass
class Section:
    """``source`` has a column ``company``; without ``by`` a subset has one row."""

    part: str
    source: str
    measures: dict[str, str]
    by: str = ""                     # grouping expressions
    name: str = "''"
    order: str = "1"
    where: str = "true"
    having: str = "true"
    labels: dict[str, str] = field(default_factory=dict)
    first: int | None = None

    def rows(self, p: Params) -> str:
        cols = ", ".join(f"{e} AS {m}" for m, e in (self.measures | self.labels).items())
        group = ", ".join(["m.subset_key", *([self.by] if self.by else [])])
        return (f"SELECT m.subset_key, {self.name} AS name, {cols} FROM {members(p)} m JOIN {self.source} s "
                f"ON s.company = m.company WHERE {self.where} GROUP BY {group} HAVING {self.having}")

    def sql(self, p: Params) -> str:
        return cells(self.part, self.rows(p), list(self.measures), list(self.labels), self.order, self.first)


def cells(part: str, rows: str, measures: list[str], labels: list[str] = (), order: str = "1",
          first: int | None = None) -> str:
    each = [f"struct_pack(measure := '{m}', value := CAST({m} AS DOUBLE), label := CAST(NULL AS VARCHAR))" for m in measures]
    each += [f"struct_pack(measure := '{m}', value := CAST(NULL AS DOUBLE), label := CAST({m} AS VARCHAR))" for m in labels]
    limit = f" WHERE place <= {first}" if first else ""
    return (f"SELECT subset_key, '{part}' AS part, place, name, c.measure AS measure, c.value AS value, c.label AS label "
            f"FROM (SELECT subset_key, place, name, unnest([{', '.join(each)}]) AS c FROM (SELECT *, CAST(row_number() OVER ("
            f"PARTITION BY subset_key ORDER BY {order}) AS INTEGER) AS place FROM ({rows})){limit})")


def joined(part: str, first: Section, others: list[tuple[str, str]], measures: list[str], p: Params,
           extra: str = "", labels: list[str] = ()) -> str:
    """A card of several aggregates, one row a subset each."""
    joins = " ".join(f"LEFT JOIN ({sql}) {alias} ON {alias}.subset_key = a.subset_key" for alias, sql in others)
    columns = "".join(f", {alias}.* EXCLUDE (subset_key, name)" for alias, _ in others)
    rows = f"SELECT a.*{columns}{extra} FROM ({first.rows(p)}) a {joins}"
    return cells(part, rows, measures, labels)


def decode(column: str, order: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(order)) + " ELSE 9 END"


def page_queries(p: Params) -> dict[str, str]:
    to, prior = p.period_to, p.prior_month
    period = f"BETWEEN '{p.period_from}' AND '{to}'"
    months, items = f"s.month {period}", f"s.invoice_month {period}"
    out: dict[str, list[str]] = {}

    # ---- overview
    days = {"ccc": CCC, "dso": DSO, "dpo": DPO, "dio": DIO}
    cards = {**days, **BALANCES, "ar_overdue": "sum(s.ar_overdue_usd)"}
    latest = Section("latest", "wc_monthly_kpi", cards, "s.month", "s.month", "name", f"s.month IN ('{prior}', '{to}')")
    compared = [c for c in cards if c != "ar_overdue"]
    delta = (f"SELECT n.subset_key, '' AS name, " + ", ".join(f"CAST(n.{c} AS DOUBLE) - CAST(b.{c} AS DOUBLE) AS {c}"
                                                               for c in compared)
             + f" FROM ({latest.rows(p)}) n LEFT JOIN ({latest.rows(p)}) b ON b.subset_key = n.subset_key "
               f"AND b.name = '{prior}' WHERE n.name = '{to}'")
    bridge = (f"SELECT subset_key, '' AS name, " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in ("dso", "dio", "dpo", "ccc"))
              + f" FROM ({latest.rows(p)}) WHERE name = '{to}'")
    one = lambda cols: {m: f"max(s.{c})" for m, c in cols.items()}
    out["overview"] = [
        latest.sql(p), cells("delta", delta, compared), cells("bridge", bridge, ["dso", "dio", "dpo", "ccc"]),
        Section("trend", "wc_monthly_kpi", {**days, "nwc": BALANCES["nwc"]}, "s.month", "s.month", "name", months).sql(p),
        Section("by_company", "wc_monthly_kpi",
                one({"dso": "dso", "dpo": "dpo", "dio": "dio", "ccc": "ccc", "nwc": "net_working_capital_usd",
                     "ar": "ar_balance_usd", "ap": "ap_balance_usd", "inventory": "inventory_usd",
                     "ar_overdue_pct": "ar_overdue_pct"}),
                "s.company", "s.company", "name", f"s.month = '{to}'", labels={"region": "max(s.region)"}).sql(p)]

    # ---- cash
    last = "s.week_end = (SELECT max(week_end) FROM bank_balance_weekly)"
    balance = {"balance": "sum(s.balance_usd)"}
    net = "s.ar_receipts_usd - s.ap_payments_usd - s.payroll_usd - s.other_opex_usd"
    start = Section("kpis", "bank_balance_weekly", {**balance, "accounts": "count(DISTINCT s.bank_account_id)"}, where=last,
                    labels={"day": "strftime(max(s.week_end), '%Y-%m-%d')"})
    paid_out = {"payments": "sum(s.ap_payments_usd + s.payroll_usd + s.other_opex_usd)", "net": f"sum({net})"}
    flows = {"receipts": "sum(s.ar_receipts_usd)", "ap_payments": "sum(s.ap_payments_usd)", "payroll": "sum(s.payroll_usd)",
             "other_opex": "sum(s.other_opex_usd)"}
    weeks = Section("forecast", "cash_forecast", {**flows, **paid_out, "week_no": "min(s.week_no)"}, "s.week_no",
                    "strftime(min(s.week_end), '%Y-%m-%d')").rows(p)
    run = (f"SELECT w.*, b.balance + sum(w.net) OVER (PARTITION BY w.subset_key ORDER BY w.week_no) AS closing_balance "
           f"FROM ({weeks}) w JOIN ({start.rows(p)}) b ON b.subset_key = w.subset_key")
    low = (f"SELECT subset_key, '' AS name, sum(net) AS forecast_net, min(closing_balance) AS min_balance FROM ({run}) "
           "GROUP BY subset_key")
    out["cash"] = [
        joined("kpis", start, [("l", low)], ["balance", "accounts", "forecast_net", "forecast_end_balance", "min_balance"], p,
               ", a.balance + l.forecast_net AS forecast_end_balance", ["day"]),
        Section("trend", "bank_balance_weekly", balance, "s.week_end, s.company",
                "strftime(s.week_end, '%Y-%m-%d') || ' ' || s.company", "name",
                f"strftime(s.week_end, '%Y-%m') {period}").sql(p),
        Section("by_bank", "bank_balance_weekly", balance, "s.house_bank", "s.house_bank", "balance DESC, name", last).sql(p),
        Section("by_purpose", "bank_balance_weekly", balance, "s.account_purpose", "s.account_purpose", "balance DESC, name",
                last).sql(p),
        cells("forecast", run, [*flows, "payments", "net", "closing_balance"], order="week_no")]

    # ---- receivables
    amounts = {"amount": "sum(s.amount_usd)", "overdue": OVERDUE}
    flagged = {"disputed": "sum(CASE WHEN s.is_disputed THEN s.amount_usd ELSE 0 END)",
               "promised": "sum(CASE WHEN s.has_promise_to_pay THEN s.amount_usd ELSE 0 END)"}
    n_items = {"items": "count(*)"}
    percent = f"round(100.0 * (CAST({OVERDUE} AS DOUBLE) / nullif(CAST(sum(s.amount_usd) AS DOUBLE), 0)), 1)"
    ar_open = Section("kpis", "ar_items", {**amounts, **flagged, **n_items, "overdue_pct": percent,
                                           "customers": "count(DISTINCT s.customer_id)"}, where="s.is_open")
    paid = Section("", "ar_items", {"on_time_pct": ON_TIME, "avg_days_to_pay": "round(avg(s.days_to_pay), 1)",
                                    "invoiced": "sum(s.amount_usd)"}, where=f"{items} AND NOT s.is_open").rows(p)

    def latest_of(day: str, sql: str) -> str:
        per = Section("", "wc_monthly_kpi", {day: sql}, "s.month", "s.month", where=months).rows(p)
        return f"SELECT subset_key, '' AS name, arg_max({day}, name) AS {day} FROM ({per}) GROUP BY subset_key"
    out["ar"] = [
        joined("kpis", ar_open, [("b", paid), ("d", latest_of("dso", DSO))],
               [*ar_open.measures, "on_time_pct", "avg_days_to_pay", "invoiced", "dso"], p),
        Section("dso_trend", "wc_monthly_kpi", {"dso": DSO, "ar": BALANCES["ar"], "ar_overdue": "sum(s.ar_overdue_usd)"},
                "s.month", "s.month", "name", months).sql(p),
        Section("aging", "ar_items", {"amount": "sum(s.amount_usd)", **n_items}, "s.aging_bucket", "s.aging_bucket",
                decode("name", ["Not Due", "1-30", "31-60", "61-90", "90+"]) + ", name", "s.is_open").sql(p),
        Section("top_overdue", "ar_items", {**amounts, "max_dpd": "max(s.days_past_due)", **flagged}, "s.customer_name",
                "s.customer_name", "overdue DESC, name", "s.is_open", f"{OVERDUE} > 0",
                {"segment": "max(s.segment)", "credit_risk": "max(s.credit_risk)"}, 15).sql(p),
        Section("dunning", "ar_items", {**n_items, "amount": "sum(s.amount_usd)"}, "coalesce(s.dunning_level, 0)",
                "'Level ' || CAST(coalesce(s.dunning_level, 0) AS VARCHAR)", "name", "s.is_open").sql(p),
        Section("by_segment", "ar_items", amounts, "s.segment", "s.segment", "amount DESC, name", "s.is_open").sql(p)]

    # ---- payables
    ap_open = Section("kpis", "ap_items", {**amounts, **n_items, "suppliers": "count(DISTINCT s.supplier_id)"},
                      where="s.is_open")
    yields = {"captured": "sum(s.discount_captured_usd)", "lost": "sum(s.discount_lost_usd)"}
    ap_paid = Section("", "ap_items", {"avg_days_to_pay": "round(avg(s.days_to_pay), 1)", "on_time_pct": ON_TIME,
                                       "paid_early_no_benefit":
                                       "sum(CASE WHEN s.paid_early_no_benefit THEN s.amount_usd ELSE 0 END)", **yields},
                      where=f"{items} AND NOT s.is_open")
    out["ap"] = [
        joined("kpis", ap_open, [("b", ap_paid.rows(p)), ("d", latest_of("dpo", DPO))],
               [*ap_open.measures, *ap_paid.measures, "dpo"], p),
        Section("dpo_trend", "wc_monthly_kpi", {"dpo": DPO, "ap": BALANCES["ap"]}, "s.month", "s.month", "name", months).sql(p),
        Section("discounts", "ap_items", yields, "s.invoice_month", "s.invoice_month", "name", items).sql(p),
        Section("aging", "ap_items", {"amount": "sum(s.amount_usd)", **n_items}, "s.aging_bucket", "s.aging_bucket",
                decode("name", ["Not Due", "1-30", "31-60", "60+"]) + ", name", "s.is_open").sql(p),
        Section("top_suppliers", "ap_items", amounts, "s.supplier_name", "s.supplier_name", "amount DESC, name", "s.is_open",
                labels={c: f"max(s.{c})" for c in ("category", "supplier_segment", "early_pay_program", "payment_terms")},
                first=15).sql(p)]

    # ---- early payment
    volume = {"amount": "sum(s.amount_usd)", **yields, "dd_opportunity": "sum(s.dd_opportunity_usd)",
              "scf_funded": "sum(s.scf_funded_usd)"}
    all_ap = Section("kpis", "ap_items", {**volume, "standard": "sum(CASE WHEN s.early_pay_program = 'Standard' THEN "
                                                                "s.amount_usd ELSE 0 END)"}, where=items)
    gained = "CASE WHEN s.days_to_pay IS NOT NULL THEN greatest(s.terms_days - s.days_to_pay, {}) END"
    apr = ("round(100.0 * CAST(sum(s.discount_captured_usd) AS DOUBLE) / nullif(CAST(sum(s.amount_usd) AS DOUBLE), 0) "
           f"* 365.0 / nullif(avg({gained.format(1)}), 0), 1)")
    dd = Section("", "ap_items", {"dd_apr_pct": apr, "days_accelerated": f"round(avg({gained.format(0)}), 1)"},
                 where=f"{items} AND s.payment_outcome = 'DD Accepted'").rows(p)
    year = Section("", "wc_monthly_kpi", {"annual_purchases": "round(CAST(sum(s.purchases_usd) AS DOUBLE) * 12.0 / "
                                                              "count(DISTINCT s.month), 2)"}, where=months).rows(p)
    out["early_pay"] = [
        joined("kpis", all_ap, [("d", dd), ("y", year)], [*all_ap.measures, "dd_apr_pct", "days_accelerated",
                                                          "annual_purchases"], p),
        Section("by_program", "ap_items",
                {"amount": volume["amount"], "suppliers": "count(DISTINCT s.supplier_id)", "captured": yields["captured"],
                 "dd_opportunity": volume["dd_opportunity"], "scf_funded": volume["scf_funded"]},
                "s.early_pay_program", "s.early_pay_program", "amount DESC, name", items).sql(p),
        Section("outcomes", "ap_items", {**n_items, "amount": volume["amount"], **yields}, "s.payment_outcome",
                "s.payment_outcome", "amount DESC, name", items).sql(p)]

    # ---- inventory
    value = {"value": "sum(s.inventory_value_usd)"}
    slow = "sum(s.inventory_value_usd * s.slow_moving_pct)"
    stock = "(SELECT i.*, c.target_dio FROM inventory_monthly i LEFT JOIN dim_inventory_category c USING (inventory_category))"
    now = f"s.month = '{to}'"
    dio = "round(CAST(sum(s.inventory_value_usd) AS DOUBLE) / nullif(CAST(sum(s.cogs_usd) AS DOUBLE), 0) * 365.0 / 12.0, 1)"
    held = Section("kpis", "inventory_monthly",
                   {"inventory": value["value"], "slow_moving": slow, "slow_moving_pct":
                    f"round(coalesce(100.0 * (CAST({slow} AS DOUBLE) / nullif(CAST(sum(s.inventory_value_usd) AS DOUBLE), 0)), "
                    "0.0), 6)"}, where=now)
    out["inventory"] = [
        joined("kpis", held, [("d", latest_of("dio", DIO))], [*held.measures, "dio"], p),
        Section("dio_trend", "wc_monthly_kpi", {"dio": DIO, "inventory": BALANCES["inventory"]}, "s.month", "s.month", "name",
                months).sql(p),
        Section("trend_by_cat", "inventory_monthly", value, "s.month, s.inventory_category",
                "s.month || ' ' || s.inventory_category", "name", months).sql(p),
        Section("categories", stock, {**value, "slow_moving": slow, "dio": dio, "target_dio": "max(s.target_dio)",
                                      "gap_days": f"{dio} - max(s.target_dio)"},
                "s.inventory_category", "s.inventory_category", "value DESC, name", now).sql(p)]

    # ---- opportunities
    release = {"cash_release": "sum(s.cash_release_usd)", "pnl_impact": "sum(s.pnl_impact_usd)"}
    totals = Section("kpis", "wc_opportunities", {m: f"coalesce({e}, 0.0)" for m, e in release.items()}
                     | {"levers": "count(DISTINCT s.lever)"})
    out["opportunities"] = [
        totals.sql(p),
        Section("rows", "wc_opportunities", {"current_days": "max(s.current_days)", "target_days": "max(s.target_days)",
                                             "cash_release": "max(s.cash_release_usd)", "pnl_impact": "max(s.pnl_impact_usd)"},
                "s.company, s.lever", "s.company || ' ' || s.lever", "cash_release DESC NULLS LAST, name",
                labels={"area": "max(s.area)"}).sql(p),
        Section("by_lever", "wc_opportunities", release, "s.lever", "s.lever", "cash_release DESC NULLS LAST, name",
                labels={"area": "max(s.area)"}).sql(p),
        Section("by_company", "wc_opportunities", release, "s.company", "s.company",
                "cash_release DESC NULLS LAST, name").sql(p)]

    queries = {f"page_{k}": " UNION ALL ".join(v) for k, v in out.items()}
    trailing = []
    for side, key in (("ar", "customer_id"), ("ap", "supplier_id")):
        for n in (1, 3, 12):
            begin = f"strftime(CAST('{to}-01' AS DATE) - INTERVAL {n - 1} MONTH, '%Y-%m')"
            trailing.append(f"SELECT m.subset_key, '{side}' AS side, {n} AS months, count(DISTINCT s.{key}) AS partners "
                            f"FROM {members(p)} m JOIN {side}_items s ON s.company = m.company "
                            f"WHERE s.invoice_month BETWEEN {begin} AND '{to}' GROUP BY m.subset_key")
    queries["page_trailing_partners"] = " UNION ALL ".join(trailing)
    return queries
