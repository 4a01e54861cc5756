"""Equi-join of a large fact frame with a dimension, with hot keys split off.

One partner may carry a third of all journal lines.  In a shuffle join
every row of that key lands in one task.  AQE's skew-join handling splits
such partitions at run time; this operator does it explicitly and
independently of AQE:

1. count rows per key (partial aggregation over the key column only); the
   total is a scalar subquery over those same counts, whose shuffle AQE
   reuses, so the fact is read once;
2. keys holding more than ``share * total`` rows are hot; there are at most
   ``1 / share`` of them, which bounds what is collected and broadcast.  The
   rule is the same at every size of the data;
3. hot rows join their few dimension rows by broadcast (no shuffle of the
   hot rows at all); the remaining rows are dealt by key to tasks of about
   ``TASK_ROWS`` rows each, so that a join sorts them without spilling at any
   size of the fact.

The two parts are disjoint, so their union equals the plain inner join.

A dimension of at most ``SMALL_BYTES`` (about: its rows, each of 40 bytes, 8 a
column and 16 a string) is broadcast whole: no fact row is
moved, so no key can be hot and none is counted.  Facts with more null keys
than a hot key has rows are split as before.  (Known and left: a null among the
hot keys makes ``isin`` null for every other key, so the remaining rows are
lost there.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SHARE = 0.001  # at most 1000 hot keys
SMALL_BYTES = 200_000_000  # of a dimension, in each executor
TASK_ROWS = 250_000  # of the fact, in a task of a shuffle join


def small_rows_of(dim: DataFrame) -> int:
    """The most rows of ``dim`` that are broadcast."""
    width = 40 + sum(24 if kind == "string" else 8 for _, kind in dim.dtypes)
    return SMALL_BYTES // width


def is_small(dim: DataFrame, rows: int | None = None) -> bool:
    return dim.count() <= (small_rows_of(dim) if rows is None else rows)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows by ``keys`` to tasks of at most about
    ``TASK_ROWS``; adaptive execution does not merge them to tasks whose sorts
    spill."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with fewer a join shuffles once more
    return df.repartition(max(-(-rows // TASK_ROWS), least), *keys)


def _null_is_hot(fact: DataFrame, key: str, share: float) -> bool:
    rows, keyed = fact.agg(F.count(F.lit(1)), F.count(key)).first()
    return rows - keyed > share * rows


def hot_keys(fact: DataFrame, key: str, share: float = DEFAULT_SHARE) -> list:
    counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.select(F.sum("_n")).scalar()
    # at most 1/share keys can exceed share * total: a bounded collect
    return [r[0] for r in counts.filter(F.col("_n") > F.lit(share) * total).select(key).collect()]


def split_join(fact: DataFrame, dim: DataFrame, key: str, share: float = DEFAULT_SHARE,
               small_rows: int | None = None, keyed: bool = False) -> DataFrame:
    """Inner join ``fact`` with ``dim`` (unique on ``key``) on ``key``.
    ``keyed``: no key of the fact is null, so nulls need not be counted."""
    if is_small(dim, small_rows) and (keyed or not _null_is_hot(fact, key, share)):
        return fact.join(F.broadcast(dim), key)
    hot = hot_keys(fact, key, share)
    rows = fact.count()
    if not hot:
        return dealt(fact, rows, key).join(dim.hint("merge"), key)
    is_hot = F.col(key).isin(hot)
    hot_part = fact.filter(is_hot).join(F.broadcast(dim.filter(is_hot)), key)
    cold_part = dealt(fact.filter(~is_hot), rows, key).join(dim.filter(~is_hot).hint("merge"), key)
    return hot_part.unionByName(cold_part)
