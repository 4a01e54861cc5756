"""Run every registered Spark query next to its DuckDB oracle SQL and compare.

    python tools/oracle_check.py [sf_dir] [key ...]

Prints one line per key (EXACT = bit-exact, TOL = equal after rounding
floats to 6 decimals, MISMATCH) and a summary.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.oracle.compare import compare, oracle_connection  # noqa: E402
from ledgerlens.oracle.sql import oracle_queries  # noqa: E402
from ledgerlens.registry import queries  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session(shuffle_partitions=int(os.environ.get("ORACLE_SHUFFLE_PARTITIONS", "8")))
    con = oracle_connection(sf)
    qs, sqls = queries(), oracle_queries()
    summary = {"exact": [], "tolerant": [], "fail": [], "no_oracle": []}
    for key, fn in qs.items():
        if only and key not in only:
            continue
        if key not in sqls:
            summary["no_oracle"].append(key)
            print(f"{key:34s} (no oracle)")
            continue
        t0 = time.time()
        try:
            r = compare(fn(spark, sf), con, sqls[key])
        except Exception as e:  # noqa: BLE001
            summary["fail"].append(key)
            print(f"{key:34s} ERROR {type(e).__name__}: {str(e)[:400]}")
            continue
        status = "EXACT" if r["exact"] else "TOL" if r["tolerant"] else "MISMATCH"
        summary["exact" if r["exact"] else "tolerant" if r["tolerant"] else "fail"].append(key)
        extra = "" if r["columns"] and r["rows"] else f" cols={r['spark_cols']} vs {r['oracle_cols']} " \
                                                       f"rows={r['n_spark']} vs {r['n_oracle']}"
        print(f"{key:34s} {status:8s} rows={r['n_spark']:6d} {time.time() - t0:5.1f}s{extra}", flush=True)
    print({k: len(v) for k, v in summary.items()})
    print("not exact:", summary["tolerant"], "failed:", summary["fail"])


if __name__ == "__main__":
    main()
