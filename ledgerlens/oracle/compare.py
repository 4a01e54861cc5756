"""Compare a Spark result with the DuckDB oracle result.

Order-insensitive: columns are matched by name, rows compared as sorted
multisets.  ``tolerant`` rounds floats to 6 decimals; otherwise floats are
compared by ``repr`` (bit-exact).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from ledgerlens.sources.tables import TABLES, table_path


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v, tol: bool):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0 if tol else repr(v)
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), tol)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, int):
        return v
    return str(v)


def canonical(rows, cols, tol: bool):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], tol) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark_df, con, sql: str) -> dict:
    s_rows, s_cols = [tuple(r) for r in spark_df.collect()], spark_df.columns
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    same_cols = sorted(s_cols) == sorted(o_cols)
    same_n = len(s_rows) == len(o_rows)
    exact = same_cols and same_n and canonical(s_rows, s_cols, False) == canonical(o_rows, o_cols, False)
    tol = same_cols and same_n and canonical(s_rows, s_cols, True) == canonical(o_rows, o_cols, True)
    return {"columns": same_cols, "rows": same_n, "exact": exact, "tolerant": tol,
            "spark_cols": sorted(s_cols), "oracle_cols": sorted(o_cols), "n_spark": len(s_rows),
            "n_oracle": len(o_rows)}
