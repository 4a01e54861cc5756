"""Subset lattice, bitmaps and page documents."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.filters import Filter
from ledgerlens.operators.bitmaps import bitmap_parts, distinct_counts
from ledgerlens.operators.lattice import company_names, of_subset, subset_totals, subsets
from ledgerlens.plans import dashboard as D
from ledgerlens.plans import pages as PG
from ledgerlens.registry import DEFAULT


def test_lattice_equals_brute_force_for_twelve_companies(spark):
    rng = random.Random(1)
    names = [f"c{i:02d}" for i in range(12)]
    rows = [(rng.choice([*names, "other", None]), rng.choice("xyz"), rng.choice([None, rng.randrange(100)]),
             rng.choice([None, rng.randrange(100)])) for _ in range(300)]
    parts = spark.createDataFrame(rows, "company string, k string, v long, w int")
    got = {(r.mask, r.k): (r.v, r.w) for r in subset_totals(parts, names, ["k"], ["v"], ["w"]).collect()}
    expected = {}
    for mask in range(2 ** 12):
        members = {n for at, n in enumerate(names) if mask >> at & 1} or set(names)
        for key in "xyz":
            own = [r for r in rows if r[1] == key and r[0] in members]
            if own:
                sums, tops = [r[2] for r in own if r[2] is not None], [r[3] for r in own if r[3] is not None]
                expected[mask, key] = (sum(sums) if sums else None, max(tops, default=None))
    assert got == expected


def test_subset_names_membership_and_limit(spark):
    names = ["a", "b", "c"]
    keyed = {r.mask: r.companies for r in subsets(spark, names).collect()}
    assert keyed == {m: ",".join(n for at, n in enumerate(names) if m >> at & 1) for m in range(8)}
    rows = spark.createDataFrame([("a",), ("c",), ("z",), (None,)], "company string")
    got = {r.company: r.m for r in rows.withColumn("m", of_subset(names)).collect()}
    assert got == {"a": [0, 1, 3, 5, 7], "c": [0, 4, 5, 6, 7], "z": None, None: None}
    assert company_names(rows) == ["a", "c", "z"]
    with pytest.raises(ValueError, match="more than 12"):
        company_names(spark.range(13).select(F.col("id").cast("string").alias("company")))


def test_bitmaps_count_distinct_over_any_union(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randrange(6), rng.choice([1, 32768, 32769, 65536, rng.randrange(1, 200000)]))
            for _ in range(3000)]
    parts = bitmap_parts(spark.createDataFrame(rows, "c string, m int, i long"), ["c", "m"], "i").cache()
    for some, months in itertools.product([{"a"}, {"a", "c"}, {"a", "b", "c"}], [1, 3, 6]):
        chosen = parts.filter(F.col("c").isin(list(some)) & (F.col("m") < months))
        got = distinct_counts(chosen, [], "n").first().n
        assert got == len({i for c, m, i in rows if c in some and m < months})


def cells(wh, page):
    out = {}
    for r in PG.page_rows(wh, page).collect():
        out.setdefault((r.subset_key.split("||")[0], r.part), {}).setdefault(
            (r.place, r.name), {})[r.measure] = r.label if r.value is None else r.value
    return out


@pytest.mark.parametrize("companies", [(), ("Japan Operations",), ("EU Operations", "US Operations")])
def test_pages_equal_the_filtered_dashboard(wh, companies):
    """A page of a subset is what the dashboard functions give for it."""
    flt = Filter(companies, DEFAULT.month_from, DEFAULT.month_to)
    ar = cells(wh, "ar")
    key = ",".join(companies)
    top = [r.asDict() for r in D.ar_top_overdue(wh, flt).collect()]
    assert [(n, c["amount"], c["overdue"], c["max_dpd"], c["segment"]) for (_, n), c in sorted(ar[key, "top_overdue"].items())
            ] == [(r["customer"], float(r["open_ar"]), float(r["overdue"]), r["max_dpd"], r["segment"]) for r in top]
    kpis = D.ar_kpis(wh, flt).first()
    card = ar[key, "kpis"][1, ""]
    assert (card["customers"], card["items"], card["overdue_pct"]) == (kpis.customers, kpis.open_items, kpis.overdue_pct)
    early = cells(wh, "early-pay")
    assert [(n, c["suppliers"]) for (_, n), c in sorted(early[key, "by_program"].items())] == [
        (r.name, r.suppliers) for r in D.ep_by_program(wh, flt).collect()]
    assert early[key, "kpis"][1, ""]["dd_apr_pct"] == D.ep_dd_apr(wh, flt).first().dd_apr_pct


def test_documents_nest_the_same_cells(wh):
    documents = {(r.page, r.subset_key): r for r in PG.page_documents(wh).collect()}
    assert len(documents) == 8 * 7 + 2
    ap = documents["ap", f"||{DEFAULT.month_from}..{DEFAULT.month_to}"]
    top = {s.part: s.rows for s in ap.sections}["top_suppliers"]
    assert [r.place for r in top] == list(range(1, len(top) + 1))
    assert [r.name for r in top] == [r.supplier for r in D.ap_top_suppliers(wh, DEFAULT).collect()]
    assert {s.part for s in documents["filters", ""].sections} == {"companies", "months", "defaults"}


def test_companies_as_data(spark, wh):
    """A company dimension of two companies: others drop out, four subsets."""
    from ledgerlens.plans.warehouse import Warehouse
    two = wh.dim_company.filter(F.col("company") != "EU Operations")
    small = Warehouse(spark, wh.sf_dir, wh.params, companies=two)
    keys = {r.subset_key for r in PG.page_rows(small, "opportunities").select("subset_key").distinct().collect()}
    assert len(keys) == 4
    assert D.lever_company_pivot(small, DEFAULT).columns == ["lever", "Japan Operations", "US Operations"]
