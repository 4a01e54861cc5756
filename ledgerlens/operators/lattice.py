"""Aggregates of every subset of the companies.

The subsets of ``n`` companies are the masks ``0 .. 2**n - 1``; the empty
subset stands for all companies, as on the dashboard.  Parts are first summed
by key and company in one shuffle.  Within a key's row the subset sums are then
built by doubling: after company ``c`` the array holds the sums of all subsets
of the companies up to ``c``, the second half being the first half plus the
part of ``c``.  That is ``n`` rounds and ``2**n`` additions a key, where
expanding every part to the subsets it is in costs ``n * 2**(n - 1)`` rows and
a shuffle of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_COMPANIES = 12


def company_names(companies: DataFrame, column: str = "company", limit: int = MAX_COMPANIES) -> list[str]:
    """The distinct names, sorted; their place is their bit.  More than
    ``limit`` companies are an error: there would be too many subsets."""
    rows = companies.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} companies: snapshots of all subsets are not offered")
    return sorted(r[0] for r in rows)


def subsets(spark: SparkSession, names: list[str]) -> DataFrame:
    """``(mask, companies)``: every subset and its names joined by commas."""
    member = [F.when(F.expr(f"(mask >> {bit}) & 1 = 1"), F.lit(name)) for bit, name in enumerate(names)]
    masks = spark.range(2 ** len(names)).select(F.col("id").cast("int").alias("mask"))
    return masks.select("mask", F.concat_ws(",", *member).alias("companies"))


def subset_totals(parts: DataFrame, names: list[str], keys: list[str], sums: list[str] = (), maxes: list[str] = (),
                  company: str = "company") -> DataFrame:
    """``(mask, *keys, *sums, *maxes)``: totals and maxima of ``parts`` over
    each subset, for the keys that the subset has rows of.  Rows of other
    companies take no part; a null measure adds nothing, and only nulls give
    null."""
    sums, maxes = list(sums), list(maxes)
    per = []
    for at, name in enumerate(names):
        own = F.col(company) == name
        per += [F.count(F.when(own, 1)).alias(f"n_{at}")]
        per += [F.sum(F.when(own, F.col(m))).alias(f"s{k}_{at}") for k, m in enumerate(sums)]
        per += [F.max(F.when(own, F.col(m))).alias(f"m{k}_{at}") for k, m in enumerate(maxes)]
    wide = parts.groupBy(*keys).agg(*per)
    kind = {f.name: f.dataType for f in wide.schema.fields}
    cells = ["n"] + [f"s{k}" for k in range(len(sums))] + [f"m{k}" for k in range(len(maxes))]
    kinds = {c: kind[f"{c}_0"] for c in cells}

    def both(cell: str, a: Column, b: Column) -> Column:
        if cell.startswith("m"):
            return F.greatest(a, b)
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b).cast(kinds[cell])

    nothing = F.struct(*[F.lit(0 if c == "n" else None).cast(kinds[c]).alias(c) for c in cells])
    each = F.array(*[F.struct(*[F.col(f"{c}_{at}").alias(c) for c in cells]) for at in range(len(names))])
    grown = F.aggregate(each, F.array(nothing), lambda acc, s: F.concat(acc, F.transform(acc, lambda x: F.struct(
        *[both(c, x[c], s[c]).alias(c) for c in cells]))))
    rows = wide.select(*keys, grown.alias("of_mask"))
    all_first = F.concat(F.array(F.element_at("of_mask", -1)), F.slice("of_mask", 2, 2 ** len(names)))
    rows = rows.select(*keys, F.posexplode(all_first).alias("mask", "x")).filter(F.col("x.n") > 0)
    return rows.select("mask", *keys, *[F.col(f"x.s{k}").alias(m) for k, m in enumerate(sums)],
                       *[F.col(f"x.m{k}").alias(m) for k, m in enumerate(maxes)])


def of_subset(names: list[str], company: str = "company") -> Column:
    """Array of the masks whose subset has the row's company (the empty
    subset, 0, has all)."""
    bit = F.coalesce(*[F.when(F.col(company) == name, F.lit(at)) for at, name in enumerate(names)])
    every = F.sequence(F.lit(0), F.lit(2 ** len(names) - 1))
    return F.when(bit.isNotNull(), F.filter(every, lambda m: (m == 0) | (F.call_function(
        "shiftright", m, bit).bitwiseAND(F.lit(1)) == 1)))
