"""The seven dashboard pages for every company subset, as documents.

Each page is a set of sections, each section a list of rows in the
dashboard's order.  A section is computed once for all subsets: its additive
parts by company go through ``operators.lattice.subset_totals``, ratios are
formed from the totals, and the rows of a subset are numbered by the section's
order.  Item tables are scanned once for the open items and once for the
period a side; every open-item section reads the stored rollup of that scan.
Distinct partners come from bitmaps over a dense partner index, united over
companies and months.  Lists of partners keep the first ``k`` of each subset:
the ranking is a window with a limit, which Spark applies in every task before
the shuffle.

``page_rows`` is one row a cell ``(subset_key, part, place, name, measure,
value, label)``; ``page_documents`` nests the same cells into one typed
document a subset.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.filters import Filter
from ledgerlens.functions.measures import safe_ratio, sum_if
from ledgerlens.operators.bitmaps import bitmap_parts, distinct_counts
from ledgerlens.operators.dense_index import dense_index
from ledgerlens.operators.lattice import company_names, of_subset, subset_totals, subsets
from ledgerlens.plans.dashboard import (AP_AGING_ORDER, AR_AGING_ORDER, TOP_CUSTOMERS, TOP_SUPPLIERS, _rank,
                                        filter_companies, filter_months)
from ledgerlens.plans.lineage import lineage_products

CELL = "array<struct<measure:string,value:double,label:string>>"
DAYS = {"dso": "revenue_usd", "dpo": "purchases_usd", "dio": "cogs_usd"}
KPI_SUMS = {"nwc": "net_working_capital_usd", "ar": "ar_balance_usd", "ap": "ap_balance_usd",
            "inventory": "inventory_usd", "ar_overdue": "ar_overdue_usd", "purchases": "purchases_usd"}
TRAILING_MONTHS = (1, 3, 12)


def _percent(part: Column | str, whole: Column | str, digits: int = 1) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    return F.round(F.lit(100.0) * safe_ratio(part, whole), digits)


@dataclass
class Pages:
    """What the pages share, each rollup built and stored once."""

    wh: object
    flt: Filter

    def __post_init__(self):
        self.names = company_names(self.wh.dim_company)
        self._built: dict[str, DataFrame] = {}

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._built:
            path = os.path.join(self.wh.root, "pages", f"{name}-{uuid.uuid4().hex[:8]}")
            df = build()
            df.write.parquet(path)
            self._built[name] = self.wh.spark.read.schema(df.schema).parquet(path)
        return self._built[name]

    def totals(self, parts: DataFrame, keys=(), sums=(), maxes=()) -> DataFrame:
        return subset_totals(parts, self.names, list(keys), list(sums), list(maxes))

    # ---- rollups ---------------------------------------------------------
    @property
    def ar_open(self) -> DataFrame:
        return self.stored("ar_open", lambda: self.wh.ar_items.filter("is_open").groupBy(
            "company", "customer_name", "segment", "credit_risk", "aging_bucket",
            F.coalesce("dunning_level", F.lit(0)).alias("level")).agg(
            F.sum("amount_usd").alias("amount"), sum_if(F.col("days_past_due") > 0, "amount_usd").alias("overdue"),
            sum_if(F.col("is_disputed"), "amount_usd").alias("disputed"),
            sum_if(F.col("has_promise_to_pay"), "amount_usd").alias("promised"), F.count(F.lit(1)).alias("items"),
            F.max("days_past_due").alias("max_dpd")))

    @property
    def ap_open(self) -> DataFrame:
        return self.stored("ap_open", lambda: self.wh.ap_items.filter("is_open").groupBy(
            "company", "supplier_name", "category", "supplier_segment", "early_pay_program", "payment_terms",
            "aging_bucket").agg(
            F.sum("amount_usd").alias("amount"), sum_if(F.col("days_past_due") > 0, "amount_usd").alias("overdue"),
            F.count(F.lit(1)).alias("items")))

    @property
    def ap_period(self) -> DataFrame:
        dtp, on_time = F.col("days_to_pay"), F.col("paid_on_time")

        def gained(least: int) -> Column:     # nothing while not paid (greatest would skip the null)
            return F.when(dtp.isNotNull(), F.greatest(F.col("terms_days") - dtp, F.lit(least)))

        return self.stored("ap_period", lambda: self.wh.ap_items.filter(self.flt.month_pred("invoice_month")).groupBy(
            "company", "invoice_month", "early_pay_program", "payment_outcome", "is_open").agg(
            F.sum("amount_usd").alias("amount"), F.sum("discount_captured_usd").alias("captured"),
            F.sum("discount_lost_usd").alias("lost"), F.sum("dd_opportunity_usd").alias("dd_opportunity"),
            F.sum("scf_funded_usd").alias("scf_funded"), F.count(F.lit(1)).alias("items"),
            sum_if(F.col("paid_early_no_benefit"), "amount_usd").alias("early_no_benefit"),
            F.count(dtp).alias("n_days"), F.sum(dtp).alias("days"), F.count(F.when(on_time, 1)).alias("n_on_time"),
            F.sum(gained(1)).alias("gained_1"), F.sum(gained(0)).alias("gained_0")))

    @property
    def kpi(self) -> DataFrame:
        """Additive KPI parts by company and month."""
        parts = [F.sum(F.col(d) * F.col(w).cast("double")).alias(f"{d}_num") for d, w in DAYS.items()]
        parts += [F.sum(F.col(w).cast("double")).alias(f"{d}_den") for d, w in DAYS.items()]
        parts += [F.sum(c).alias(m) for m, c in KPI_SUMS.items()]
        return self.wh.wc_monthly_kpi.groupBy("company", "month").agg(*parts)

    def months(self) -> DataFrame:
        """KPI totals by subset and month, day metrics formed."""
        def build():
            t = self.totals(self.kpi, ["month"], [f"{d}_{x}" for d in DAYS for x in ("num", "den")] + list(KPI_SUMS))
            t = t.withColumns({d: F.round(safe_ratio(f"{d}_num", f"{d}_den"), 1) for d in DAYS})
            return t.withColumn("ccc", F.round(F.col("dso") + F.col("dio") - F.col("dpo"), 1))
        return self.stored("months", build)

    def period_months(self) -> DataFrame:
        return self.months().filter(self.flt.month_pred("month"))

    def partner_sets(self, side: str) -> DataFrame:
        """``(company, month, is_open, program, block, bits)``: the partners of
        a side's items as bitmaps over the dense partner index."""
        def build():
            key, items = ("customer_id", self.wh.ar_items) if side == "ar" else ("supplier_id", self.wh.ap_items)
            dim = self.wh.dim_customer if side == "ar" else self.wh.dim_supplier
            index = dense_index(dim.select(key), key, "rn")
            program = F.lit(None).cast("string") if side == "ar" else F.col("early_pay_program")
            keys = ["company", "invoice_month", "is_open", "program"]
            some = items.withColumn("program", program).select(*keys, key).distinct()
            return bitmap_parts(some.join(index, key), keys, "rn")
        return self.stored(f"{side}_partners", build)

    def partners(self, side: str, where: Column, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
        """``(mask, *keys, out)``: distinct partners of each subset."""
        sets = self.partner_sets(side).filter(where).withColumn("mask", F.explode(of_subset(self.names)))
        return distinct_counts(sets, ["mask", *keys], out)

    # ---- sections --------------------------------------------------------
    def section(self, rows: DataFrame, part: str, measures: list[str], order: list[Column], name: Column | None = None,
                labels: list[str] = (), first: int | None = None) -> DataFrame:
        """Rows of a section as ``(mask, part, place, name, cells)``; the
        ``first`` of each subset if given."""
        place = F.row_number().over(Window.partitionBy("mask").orderBy(*order))
        rows = rows.withColumn("__place", place)
        if first is not None:
            rows = rows.filter(F.col("__place") <= first)
        cells = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"),
                          F.lit(None).cast("string").alias("label")) for m in measures]
        cells += [F.struct(F.lit(m).alias("measure"), F.lit(None).cast("double").alias("value"),
                           F.col(m).cast("string").alias("label")) for m in labels]
        return rows.select("mask", F.lit(part).alias("part"), F.col("__place").alias("place"),
                           (F.lit("") if name is None else name.cast("string")).alias("name"),
                           F.array(*cells).cast(CELL).alias("cells"))

    def overview(self) -> list[DataFrame]:
        to, prior = self.flt.month_to, self.flt.prior
        month, m = F.col("month"), self.months()
        cards = ["ccc", "dso", "dpo", "dio", "nwc", "ar", "ap", "inventory", "ar_overdue"]
        latest = m.filter(month.isin(prior, to))
        compared = [c for c in cards if c != "ar_overdue"]

        def at(which: str, c: str) -> Column:
            return F.max(F.when(month == which, F.col(c).cast("double")))
        delta = latest.groupBy("mask").agg(*[(at(to, c) - at(prior, c)).alias(c) for c in compared])
        bridge = latest.filter(month == to).select("mask", *[F.coalesce(c, F.lit(0.0)).alias(c)
                                                             for c in ("dso", "dio", "dpo", "ccc")])
        k = self.wh.wc_monthly_kpi.filter(month == to).select(
            "company", "region", "dso", "dpo", "dio", "ccc", F.col("net_working_capital_usd").alias("nwc"),
            F.col("ar_balance_usd").alias("ar"), F.col("ap_balance_usd").alias("ap"),
            F.col("inventory_usd").alias("inventory"), "ar_overdue_pct")
        k = k.withColumn("mask", F.explode(of_subset(self.names)))
        by_company = ["dso", "dpo", "dio", "ccc", "nwc", "ar", "ap", "inventory", "ar_overdue_pct"]
        return [self.section(latest, "latest", cards, [month], month),
                self.section(delta, "delta", compared, [F.lit(0)]),
                self.section(bridge, "bridge", ["dso", "dio", "dpo", "ccc"], [F.lit(0)]),
                self.section(self.period_months(), "trend", ["ccc", "dso", "dpo", "dio", "nwc"], [month], month),
                self.section(k, "by_company", by_company, [F.col("company")], F.col("company"), ["region"])]

    def cash(self) -> list[DataFrame]:
        bank = self.wh.bank_balance_weekly
        last = bank.filter(F.col("week_end") == bank.agg(F.max("week_end")).scalar())
        day = F.date_format("week_end", "yyyy-MM-dd")
        in_period = bank.filter(self.flt.month_pred(F.date_format("week_end", "yyyy-MM"))).withColumn("week", day)
        start = self.totals(last.withColumn("accounts", F.lit(1)).withColumn("day", day), [], ["balance_usd", "accounts"],
                            ["day"])
        flows = {"receipts": "ar_receipts_usd", "ap_payments": "ap_payments_usd", "payroll": "payroll_usd",
                 "other_opex": "other_opex_usd"}
        fc = self.wh.cash_forecast.withColumns({m: F.col(c) for m, c in flows.items()}).withColumn("week_day", day)
        weeks = self.totals(fc, ["week_no"], list(flows), ["week_day"])
        weeks = weeks.withColumn("payments", F.col("ap_payments") + F.col("payroll") + F.col("other_opex"))
        weeks = weeks.withColumn("net", F.col("receipts") - F.col("payments"))
        run = Window.partitionBy("mask").orderBy("week_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        weeks = (weeks.join(start.select("mask", F.col("balance_usd").alias("start")), "mask", "left")
                 .withColumn("closing_balance", F.coalesce("start", F.lit(0)) + F.sum("net").over(run)))
        low = weeks.groupBy("mask").agg(F.sum("net").alias("forecast_net"), F.min("closing_balance").alias("min_balance"))
        cards = (start.withColumnRenamed("balance_usd", "balance").join(low, "mask", "left")
                 .withColumn("forecast_end_balance", F.col("balance") + F.col("forecast_net")))
        grouped = lambda c: self.totals(last, [c], ["balance_usd"]).withColumnRenamed("balance_usd", "balance")
        trend = self.totals(in_period.withColumn("who", F.col("company")), ["week", "who"], ["balance_usd"])
        big = F.desc("balance")
        return [self.section(cards, "kpis", ["balance", "accounts", "forecast_net", "forecast_end_balance", "min_balance"],
                             [F.lit(0)], None, ["day"]),
                self.section(trend.withColumnRenamed("balance_usd", "balance"), "trend", ["balance"],
                             [F.col("week"), F.col("who")], F.concat_ws(" ", "week", "who")),
                self.section(grouped("house_bank"), "by_bank", ["balance"], [big, F.col("house_bank")], F.col("house_bank")),
                self.section(grouped("account_purpose"), "by_purpose", ["balance"], [big, F.col("account_purpose")],
                             F.col("account_purpose")),
                self.section(weeks, "forecast", [*flows, "payments", "net", "closing_balance"], [F.col("week_no")],
                             F.col("week_day"))]

    def ar(self) -> list[DataFrame]:
        rows = self.ar_open
        sums = ["amount", "overdue", "disputed", "promised", "items"]
        paid = self.wh.ar_items.filter(self.flt.month_pred("invoice_month") & ~F.col("is_open")).groupBy("company").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("paid_on_time"), 1)).alias("on_time"),
            F.count("days_to_pay").alias("n_days"), F.sum("days_to_pay").alias("days"),
            F.sum("amount_usd").alias("invoiced"))
        paid = self.totals(paid, [], ["n", "on_time", "n_days", "days", "invoiced"])
        paid = paid.select("mask", _percent("on_time", "n").alias("on_time_pct"),
                           F.round(safe_ratio("days", "n_days"), 1).alias("avg_days_to_pay"), "invoiced")
        last = self.period_months().groupBy("mask").agg(F.max_by("dso", "month").alias("dso"))
        cards = (self.totals(rows, [], sums).withColumn("overdue_pct", _percent("overdue", "amount"))
                 .join(self.partners("ar", F.col("is_open"), "customers"), "mask", "left")
                 .join(paid, "mask", "full").join(last, "mask", "full"))
        by = lambda c: self.totals(rows, [c], ["amount", "overdue", "items"])
        top = self.totals(rows, ["customer_name"], ["amount", "overdue", "disputed", "promised"],
                          ["segment", "credit_risk", "max_dpd"]).filter(F.col("overdue") > 0)
        name = F.col("customer_name")
        month = F.col("month")
        return [self.section(cards, "kpis", [*sums, "overdue_pct", "customers", "on_time_pct", "avg_days_to_pay", "invoiced",
                                             "dso"], [F.lit(0)]),
                self.section(self.period_months(), "dso_trend", ["dso", "ar", "ar_overdue"], [month], month),
                self.section(by("aging_bucket"), "aging", ["amount", "items"],
                             [_rank("aging_bucket", AR_AGING_ORDER), F.col("aging_bucket")], F.col("aging_bucket")),
                self.section(top, "top_overdue", ["amount", "overdue", "max_dpd", "disputed", "promised"],
                             [F.desc("overdue"), name], name, ["segment", "credit_risk"], TOP_CUSTOMERS),
                self.section(by("level"), "dunning", ["items", "amount"], [F.col("level")],
                             F.concat(F.lit("Level "), F.col("level").cast("string"))),
                self.section(by("segment"), "by_segment", ["amount", "overdue"], [F.desc("amount"), F.col("segment")],
                             F.col("segment"))]

    def ap(self) -> list[DataFrame]:
        rows, period = self.ap_open, self.ap_period
        sums = ["amount", "overdue", "items"]
        paid = self.totals(period.filter(~F.col("is_open")), [], ["items", "n_on_time", "n_days", "days", "early_no_benefit",
                                                                  "captured", "lost"])
        paid = paid.select("mask", F.round(safe_ratio("days", "n_days"), 1).alias("avg_days_to_pay"),
                           _percent("n_on_time", "items").alias("on_time_pct"),
                           F.col("early_no_benefit").alias("paid_early_no_benefit"), "captured", "lost")
        last = self.period_months().groupBy("mask").agg(F.max_by("dpo", "month").alias("dpo"))
        cards = (self.totals(rows, [], sums).join(self.partners("ap", F.col("is_open"), "suppliers"), "mask", "left")
                 .join(paid, "mask", "full").join(last, "mask", "full"))
        top = self.totals(rows, ["supplier_name"], ["amount", "overdue"],
                          ["category", "supplier_segment", "early_pay_program", "payment_terms"])
        name, month = F.col("supplier_name"), F.col("month")
        aging = self.totals(rows, ["aging_bucket"], ["amount", "items"])
        discounts = self.totals(period, ["invoice_month"], ["captured", "lost"])
        return [self.section(cards, "kpis", [*sums, "suppliers", "avg_days_to_pay", "on_time_pct", "paid_early_no_benefit",
                                             "captured", "lost", "dpo"], [F.lit(0)]),
                self.section(self.period_months(), "dpo_trend", ["dpo", "ap"], [month], month),
                self.section(discounts, "discounts", ["captured", "lost"], [F.col("invoice_month")], F.col("invoice_month")),
                self.section(aging, "aging", ["amount", "items"],
                             [_rank("aging_bucket", AP_AGING_ORDER), F.col("aging_bucket")], F.col("aging_bucket")),
                self.section(top, "top_suppliers", ["amount", "overdue"], [F.desc("amount"), name], name,
                             ["category", "supplier_segment", "early_pay_program", "payment_terms"], TOP_SUPPLIERS)]

    def early_pay(self) -> list[DataFrame]:
        period = self.ap_period
        sums = ["amount", "captured", "lost", "dd_opportunity", "scf_funded"]
        standard = F.when(F.col("early_pay_program") == "Standard", F.col("amount")).otherwise(F.lit(0))
        cards = self.totals(period.withColumn("standard", standard), [], [*sums, "standard"])
        dd = self.totals(period.filter(F.col("payment_outcome") == "DD Accepted"), [],
                         ["amount", "captured", "n_days", "gained_1", "gained_0"])
        mean = safe_ratio("gained_1", "n_days")
        apr = (F.lit(100.0) * F.col("captured").cast("double") / F.when(F.col("amount") != 0, F.col("amount").cast("double"))
               * F.lit(365.0) / F.when(mean != 0, mean))
        dd = dd.select("mask", F.round(apr, 1).alias("dd_apr_pct"),
                       F.round(safe_ratio("gained_0", "n_days"), 1).alias("days_accelerated"))
        year = self.period_months().groupBy("mask").agg(F.sum("purchases").alias("p"), F.count(F.lit(1)).alias("months"))
        year = year.select("mask", F.round(F.col("p").cast("double") * 12.0 / F.col("months"), 2).alias("annual_purchases"))
        cards = cards.join(dd, "mask", "left").join(year, "mask", "left")
        program, outcome, big = F.col("early_pay_program"), F.col("payment_outcome"), F.desc("amount")
        suppliers = self.partners("ap", self.flt.month_pred("invoice_month"), "suppliers", ("program",))
        by_program = self.totals(period, ["early_pay_program"], ["amount", "captured", "dd_opportunity", "scf_funded"])
        by_program = by_program.join(suppliers.withColumnRenamed("program", "early_pay_program"),
                                     ["mask", "early_pay_program"], "left")
        return [self.section(cards, "kpis", [*sums, "standard", "dd_apr_pct", "days_accelerated", "annual_purchases"],
                             [F.lit(0)]),
                self.section(by_program, "by_program", ["amount", "suppliers", "captured", "dd_opportunity", "scf_funded"],
                             [big, program], program),
                self.section(self.totals(period, ["payment_outcome"], ["items", "amount", "captured", "lost"]), "outcomes",
                             ["items", "amount", "captured", "lost"], [big, outcome], outcome)]

    def inventory(self) -> list[DataFrame]:
        inv, month = self.wh.inventory_monthly, F.col("month")
        slow = F.col("inventory_value_usd") * F.col("slow_moving_pct")
        parts = inv.select("company", "month", "inventory_category", F.col("inventory_value_usd").alias("value"),
                           slow.alias("slow_moving"), F.col("cogs_usd").alias("cogs"))
        trend = self.totals(parts.filter(self.flt.month_pred("month")), ["month", "inventory_category"], ["value"])
        target = F.broadcast(self.wh.dim_inventory_category.select("inventory_category", "target_dio"))
        cats = self.totals(parts.filter(month == self.flt.month_to), ["inventory_category"], ["value", "slow_moving", "cogs"])
        cats = (cats.withColumn("dio", F.round(safe_ratio("value", "cogs") * F.lit(365.0) / F.lit(12.0), 1))
                .join(target, "inventory_category", "left").withColumn("gap_days", F.col("dio") - F.col("target_dio")))
        last = self.period_months().groupBy("mask").agg(F.max_by("dio", "month").alias("dio"))
        cards = cats.groupBy("mask").agg(F.sum("value").alias("inventory"), F.sum("slow_moving").alias("slow_moving"))
        cards = cards.withColumn("slow_moving_pct", F.round(F.coalesce(F.lit(100.0) * safe_ratio("slow_moving", "inventory"),
                                                                       F.lit(0.0)), 6)).join(last, "mask", "left")
        cat = F.col("inventory_category")
        return [self.section(cards, "kpis", ["inventory", "slow_moving", "slow_moving_pct", "dio"], [F.lit(0)]),
                self.section(self.period_months(), "dio_trend", ["dio", "inventory"], [month], month),
                self.section(trend, "trend_by_cat", ["value"], [month, cat], F.concat_ws(" ", month, cat)),
                self.section(cats, "categories", ["value", "slow_moving", "dio", "target_dio", "gap_days"],
                             [F.desc("value"), cat], cat)]

    def opportunities(self) -> list[DataFrame]:
        opp = self.wh.wc_opportunities.select("company", "lever", "area", "current_days", "target_days",
                                              F.col("cash_release_usd").alias("cash_release"),
                                              F.col("pnl_impact_usd").alias("pnl_impact"))
        sums, lever, big = ["cash_release", "pnl_impact"], F.col("lever"), F.desc("cash_release")
        rows = opp.withColumn("mask", F.explode(of_subset(self.names)))
        by_lever = self.totals(opp, ["lever"], sums, ["area"])
        cards = by_lever.groupBy("mask").agg(*[F.sum(F.coalesce(m, F.lit(0.0))).alias(m) for m in sums],
                                             F.count(F.lit(1)).alias("levers"))
        who = F.col("who")
        return [self.section(cards, "kpis", [*sums, "levers"], [F.lit(0)]),
                self.section(rows, "rows", ["current_days", "target_days", *sums], [big, F.col("company"), lever],
                             F.concat_ws(" ", "company", "lever"), ["area"]),
                self.section(by_lever, "by_lever", sums, [big, lever], lever, ["area"]),
                self.section(self.totals(opp.withColumn("who", F.col("company")), ["who"], sums), "by_company", sums,
                             [big, who], who)]

    def page(self, page: str) -> DataFrame:
        """``(mask, part, place, name, cells)`` of a page."""
        sections = getattr(self, page.replace("-", "_"))()
        return reduce(DataFrame.unionByName, sections)

    def keyed(self, rows: DataFrame) -> DataFrame:
        period = F.lit(f"||{self.flt.month_from}..{self.flt.month_to}")
        named = subsets(self.wh.spark, self.names).select("mask", F.concat("companies", period).alias("subset_key"))
        return rows.join(named, "mask").drop("mask")

    def trailing_partners(self) -> DataFrame:
        """``(subset_key, side, months, partners)``: distinct partners invoiced
        in the last ``months`` months of the period."""
        out = []
        last = F.lit(f"{self.flt.month_to}-01").cast("date")
        for side in ("ar", "ap"):
            for n in TRAILING_MONTHS:
                begin = F.date_format(F.add_months(last, 1 - n), "yyyy-MM")
                some = self.partners(side, F.col("invoice_month").between(begin, F.lit(self.flt.month_to)), "partners")
                out.append(some.withColumns({"side": F.lit(side), "months": F.lit(n)}))
        return self.keyed(reduce(DataFrame.unionByName, out)).select("subset_key", "side", "months", "partners")


PAGES = ("overview", "cash", "ar", "ap", "early-pay", "inventory", "opportunities")


def pages(wh, flt: Filter | None = None) -> Pages:
    """The pages of a period, rollups shared by all calls for it."""
    flt = flt or Filter((), wh.params.period_from, wh.params.period_to)
    known = wh.__dict__.setdefault("_pages", {})
    return known.setdefault((flt.month_from, flt.month_to), Pages(wh, flt))


def page_rows(wh, page: str, flt: Filter | None = None) -> DataFrame:
    """One row a cell of a page, for every subset."""
    p = pages(wh, flt)
    return p.keyed(p.page(page)).select("subset_key", "part", "place", "name", F.inline("cells"))


def _single(wh, flt: Filter) -> DataFrame:
    """The documents that no subset keys: the filter lists with the defaults,
    and the source products with their row counts."""
    def cell(measure: str, value: Column | None, label: Column | None) -> Column:
        return F.array(F.struct(F.lit(measure).alias("measure"), F.lit(None).cast("double").alias("value")
                                if value is None else value.cast("double").alias("value"),
                                (F.lit(None) if label is None else label).cast("string").alias("label"))).cast(CELL)

    def listed(page: str, part: str, df: DataFrame, name: Column, cells: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(name))   # a few dozen rows
        return df.select(F.lit(page).alias("page"), F.lit("").alias("subset_key"), F.lit(part).alias("part"),
                         place.alias("place"), name.alias("name"), cells.alias("cells"))

    defaults = {"default_from": flt.month_from, "default_to": flt.month_to, "as_of": str(wh.params.as_of), "currency": "USD"}
    settings = wh.spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]))
                                        .alias("name", "v"))
    products = lineage_products(wh)
    return reduce(DataFrame.unionByName, [
        listed("filters", "companies", filter_companies(wh), F.col("v"), cell("company", None, F.col("v"))),
        listed("filters", "months", filter_months(wh), F.col("v"), cell("month", None, F.col("v"))),
        listed("filters", "defaults", settings, F.col("name"), cell("setting", None, F.col("v"))),
        listed("lineage", "products", products, F.col("data_product"), cell("rows", F.col("rows"), F.col("usage")))])


def page_documents(wh, flt: Filter | None = None) -> DataFrame:
    """``(page, subset_key, sections)``: one typed document a page and subset,
    ``sections`` an array of ``(part, rows)`` with rows in the page's order.
    The pages ``filters`` and ``lineage`` have one document each."""
    p = pages(wh, flt)
    every = reduce(DataFrame.unionByName, [p.page(x).withColumn("page", F.lit(x)) for x in PAGES])
    rows = p.stored("every", lambda: p.keyed(every).unionByName(_single(wh, p.flt)))
    of_part = rows.groupBy("page", "subset_key", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "name", "cells"))).alias("rows"))
    return of_part.groupBy("page", "subset_key").agg(F.array_sort(F.collect_list(F.struct("part", "rows")))
                                                     .alias("sections"))
