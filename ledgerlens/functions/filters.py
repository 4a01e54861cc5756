"""Dashboard filter builder.

An empty company list means all companies; a month that is not
'YYYY-MM' falls back to the default; a reversed range is swapped.
The result is a plain Column predicate, so Catalyst pushes it into the
parquet scan of the curated tables (the item tables are written
partitioned by invoice month).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.calendar import MONTH_RE, prior_year_month


def parse_list(raw) -> list[str]:
    if isinstance(raw, (list, tuple)):
        return [str(v).strip() for v in raw if str(v).strip()]
    if not isinstance(raw, str) or raw.strip() == "":
        return []
    return [v.strip() for v in raw.split(",") if v.strip()]


def period(from_, to_, default_from: str, default_to: str) -> tuple[str, str]:
    f = str(from_ or "")
    t = str(to_ or "")
    f = f if MONTH_RE.match(f) else default_from
    t = t if MONTH_RE.match(t) else default_to
    if f > t:
        f, t = t, f
    return f, t


@dataclass(frozen=True)
class Filter:
    """Companies (names) plus a month period; built once per request."""

    companies: tuple[str, ...] = ()
    month_from: str = ""
    month_to: str = ""

    @staticmethod
    def build(companies=None, from_=None, to_=None, *, default_from: str, default_to: str) -> "Filter":
        f, t = period(from_, to_, default_from, default_to)
        return Filter(tuple(parse_list(companies)), f, t)

    @property
    def prior(self) -> str:
        return prior_year_month(self.month_to)

    def company_pred(self, col: str = "company") -> Column:
        if not self.companies:
            return F.lit(True)
        return F.col(col).isin(list(self.companies))

    def month_pred(self, month_col) -> Column:
        c = F.col(month_col) if isinstance(month_col, str) else month_col
        return c.between(F.lit(self.month_from), F.lit(self.month_to))

    def where(self, month_col=None, extra: list[Column] | None = None, company_col: str = "company") -> Column:
        parts = list(extra or [])
        parts.append(self.company_pred(company_col))
        if month_col is not None:
            parts.append(self.month_pred(month_col))
        return reduce(lambda a, b: a & b, parts)
