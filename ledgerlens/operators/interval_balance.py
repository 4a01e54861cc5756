"""Open balances at month ends by event deltas.

The balance at month end ``m`` is the sum of items with
``start <= m < end``.  Joining every month to every item on that range is a
theta join whose only equi-key is the company, i.e. a handful of hot keys.
Instead each item emits ``+amount`` at the month end of its start and
``-amount`` at the month end of its end (only if that is later); the deltas
are summed per (key, month end) with map-side partial aggregation, and a
running sum over the few rows per key gives the balance.  Exact with
DECIMAL amounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_struct(month: Column, fields: dict[str, Column], schema: T.StructType) -> Column:
    """One event row: ``month`` plus the given measure fields, others null."""
    vals = []
    for f in schema.fields:
        if f.name == "month_end":
            vals.append(month.alias("month_end"))
        elif f.name in fields:
            vals.append(fields[f.name].cast(f.dataType).alias(f.name))
        else:
            vals.append(F.lit(None).cast(f.dataType).alias(f.name))
    return F.struct(*vals)


def explode_events(df: DataFrame, keys: list[str], events: list[Column]) -> DataFrame:
    """Emit the listed event structs per row; rows with a null month are dropped."""
    return (df.select(*keys, F.inline(F.array(*events)))
              .filter(F.col("month_end").isNotNull()))


def opened_closed(start_me: Column, end_me: Column) -> tuple[Column, Column]:
    """Months at which an item enters and leaves the open balance.

    Null when the item is never open at a month end (end not after start).
    """
    live = end_me > start_me
    return F.when(live, start_me), F.when(live, end_me)


def running_total(df: DataFrame, keys: list[str], order_col: str, delta_cols: dict[str, str]) -> DataFrame:
    """Add cumulative sums (``out <- delta``) over ``order_col`` within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for out, delta in delta_cols.items():
        df = df.withColumn(out, F.sum(F.coalesce(F.col(delta), F.lit(0))).over(w))
    return df
