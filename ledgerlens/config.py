"""Run parameters.

Every date the pipeline depends on is a parameter; nothing is read from the
wall clock.  ``TEST_PARAMS`` is the configuration for the TPC-H-like test
tables (orders run 1995-01-01 .. 2001-08-01, so the last full month is July
2001).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def _last_day(d: dt.date) -> dt.date:
    nxt = dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)
    return nxt - dt.timedelta(days=1)


def _add_months(d: dt.date, n: int) -> dt.date:
    m = d.month - 1 + n
    y = d.year + m // 12
    first = dt.date(y, m % 12 + 1, 1)
    return min(_last_day(first), first.replace(day=min(d.day, _last_day(first).day)))


@dataclass(frozen=True)
class Params:
    as_of: dt.date
    history_start: dt.date  # spine months start here (AR invoices on or after)
    kpi_start: dt.date  # first KPI month end (third month, after the window)
    period_from: str  # default dashboard period 'YYYY-MM'
    period_to: str
    bank_first_week: dt.date  # first Friday of the 65-week bank series
    bank_weeks: int = 65
    forecast_weeks: int = 13

    # ---- derived -----------------------------------------------------
    @property
    def prior_month(self) -> str:
        """'YYYY-MM' twelve months before ``period_to``."""
        return f"{int(self.period_to[:4]) - 1}{self.period_to[4:]}"

    @property
    def latest_month(self) -> str:
        return self.period_to

    @property
    def cut_6m(self) -> dt.date:
        """Month ends strictly after this date are the last six months."""
        return _last_day(_add_months(self.as_of, -6))

    @property
    def cut_12m(self) -> dt.date:
        return _last_day(_add_months(self.as_of, -12))

    @property
    def bank_last_week(self) -> dt.date:
        """Last Friday on or before the as-of date."""
        return self.as_of - dt.timedelta(days=(self.as_of.weekday() - 4) % 7)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


TEST_PARAMS = Params(
    as_of=_d("2001-07-31"),
    history_start=_d("1995-01-01"),
    kpi_start=_d("1995-03-31"),
    period_from="2000-08",
    period_to="2001-07",
    bank_first_week=_d("2000-05-05"),
)

# An earlier date at which the items, flows and KPIs are also checked.
EARLY_AS_OF = _d("1999-12-31")
