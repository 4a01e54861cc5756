"""Literal-driven cash functions (not registered as queries): checked against
the DuckDB formulation of the same model."""

import pytest

from testdata_paths import SF_SMALL
from ledgerlens.oracle.compare import compare, oracle_connection
from ledgerlens.oracle.sql import prelude
from ledgerlens.plans import dashboard as D
from ledgerlens.plans import facts as FA
from ledgerlens.registry import DEFAULT, SUBSET, to_output

PRE = prelude()
LATEST = "(SELECT MAX(week_end) FROM bank_balance_weekly)"
SQL = {
    "bank": "SELECT * REPLACE (CAST(balance_usd AS DOUBLE) AS balance_usd) FROM bank_balance_weekly",
    "cash_total": "SELECT MAX(week_end) AS week_end, CAST(SUM(balance_usd) AS DOUBLE) AS balance, "
                  f"COUNT(DISTINCT bank_account_id) AS accounts FROM bank_balance_weekly WHERE week_end = {LATEST}",
    "cash_by_bank": "SELECT house_bank AS name, CAST(SUM(balance_usd) AS DOUBLE) AS balance FROM bank_balance_weekly "
                    f"WHERE week_end = {LATEST} GROUP BY 1",
    "cash_trend": "SELECT strftime(week_end, '%Y-%m-%d') AS week, company AS name, CAST(SUM(balance_usd) AS DOUBLE) "
                  "AS balance FROM bank_balance_weekly WHERE strftime(week_end, '%Y-%m') BETWEEN '2000-08' AND "
                  "'2001-07' GROUP BY 1, 2",
    "ask_cash_now": "SELECT company, CAST(SUM(balance_usd) AS DOUBLE) AS balance FROM bank_balance_weekly "
                    f"WHERE week_end = {LATEST} GROUP BY 1",
}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_SMALL)


def test_bank_table_matches(wh, con):
    assert wh.bank_balance_weekly.count() == 9 * 65
    assert compare(to_output(wh.bank_balance_weekly), con, PRE + SQL["bank"])["exact"]


@pytest.mark.parametrize("key,fn", [("cash_total", D.cash_total), ("cash_by_bank", D.cash_by_bank),
                                    ("cash_trend", D.cash_trend)])
def test_cash_queries(wh, con, key, fn):
    assert compare(to_output(fn(wh, DEFAULT)), con, PRE + SQL[key])["exact"]


def test_cash_now_and_latest_week_is_global(wh, con):
    assert compare(to_output(FA.ask_cash_now(wh)), con, PRE + SQL["ask_cash_now"])["exact"]
    sub = D.cash_total(wh, SUBSET).first()
    assert sub.accounts == 6 and str(sub.week_end) == "2001-07-27"


def test_pivot_and_purpose(wh):
    p = D.cash_trend_pivot(wh, DEFAULT)
    assert p.columns == ["week", "EU Operations", "Japan Operations", "US Operations"]
    assert p.count() == D.cash_trend(wh, DEFAULT).select("week").distinct().count()
    purposes = [r.name for r in D.cash_by_purpose(wh, DEFAULT).collect()]
    assert sorted(purposes) == ["Investment", "Operating", "Payroll"]
    weekly = FA.ask_weekly_26(wh).collect()
    assert len(weekly) == 26 and weekly[0].week == "2001-07-27"


def test_literal_dimensions(wh):
    assert wh.dim_company.count() == 3
    assert wh.dim_bank_account.count() == 9
    shares = wh.dim_inventory_category.agg({"cogs_share": "sum"}).first()[0]
    assert float(shares) == 1.0
