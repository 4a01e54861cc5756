"""Print the physical plan outline of registered queries.

    python tools/show_plans.py [sf_dir] key [key ...]

For each key: the operator tree of ``explain("formatted")`` plus the scan
details (PushedFilters, PartitionFilters, ReadSchema) and the exchange
partitionings, which is what to check for pushdown, pruning and shuffles.
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.registry import queries  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402

KEEP = re.compile(r"^(PushedFilters|PartitionFilters|ReadSchema|Arguments: (hashpartitioning|rangepartitioning|"
                  r"SinglePartition|HashedRelationBroadcastMode))")


def outline(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree, _, details = text.partition("\n\n\n")
    keep = [ln for ln in details.splitlines() if KEEP.match(ln.strip())]
    return tree.strip() + "\n" + "\n".join(keep)


def build_plan(spark, sf: str, name: str):
    """Plans of the pipeline steps themselves (over the materialised inputs)."""
    from ledgerlens.config import TEST_PARAMS as P
    from ledgerlens.plans import dims, flows, items
    from ledgerlens.plans.warehouse import get_warehouse, layout
    wh = get_warehouse(spark, sf, P)
    if name == "monthly_flows":
        return flows.monthly_flows(wh.ar_core, wh.ap_core, P.history_start, P.as_of)
    if name == "ar_core":
        return layout("ar_core", items.ar_core(wh.journal, wh.dim_customer, wh.dim_company))
    if name == "partner_ids":
        return dims.partner_ids(wh.journal, "customer")
    raise KeyError(name)


def main() -> None:
    sf = sys.argv[1]
    keys = sys.argv[2:]
    spark = build_session()
    qs = queries()
    for k in keys:
        df = build_plan(spark, sf, k[6:]) if k.startswith("build:") else qs[k](spark, sf)
        print(f"### {k}\n```\n{outline(df)}\n```\n")


if __name__ == "__main__":
    main()
