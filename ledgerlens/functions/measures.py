"""Aggregate and rounding helpers shared by every query.

Money is carried as DECIMAL(18,2) so sums are exact on any engine; day
ratios are DOUBLE.  Formulas with a division by days (discount yields)
are computed in DOUBLE and rounded half-up on the binary value with
``floor(x * 10^n + 0.5) / 10^n``, which is bit-identical across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_money(c) -> Column:
    return _c(c).cast(MONEY)


def round_half_up_double(c, n: int = 2) -> Column:
    """Half-up rounding of a non-negative DOUBLE, portable across engines."""
    p = float(10 ** n)
    return F.floor(_c(c).cast("double") * p + 0.5) / p


def sum_if(pred: Column, value) -> Column:
    """SUM(IFF(pred, value, 0))."""
    return F.sum(F.when(pred, _c(value)).otherwise(F.lit(0)))


def safe_ratio(num, den) -> Column:
    """num / NULLIF(den, 0) in DOUBLE."""
    den = _c(den).cast("double")
    return _c(num).cast("double") / F.when(den != 0, den)


def weighted_ratio(value, weight, digits: int = 1) -> Column:
    """ROUND(SUM(value*weight) / NULLIF(SUM(weight), 0), digits)."""
    w = _c(weight).cast("double")
    return F.round(safe_ratio(F.sum(_c(value) * w), F.sum(w)), digits)


def sorted_small(*cols):
    """``DataFrame.transform`` step ordering a result whose size is bounded
    (months, companies, categories, buckets, weeks): one partition, sorted in
    place.  A global ``orderBy`` would add a range-partitioning exchange with
    its own sampling job, which costs more than the sort of a few rows."""
    return lambda df: df.repartition(1).sortWithinPartitions(*cols)
