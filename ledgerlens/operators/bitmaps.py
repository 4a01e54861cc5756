"""Distinct counts that add up: bitmaps over a dense index.

A distinct count does not add across companies or months, but a set of ids
does: the sets are kept as bitmaps, a fixed size (4 KB) per 32,768 index
numbers, and united by ``bitmap_or_agg``.  Counts are exact.  A union touches
bitmaps, not ids, so any subset and any period costs the same few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap_parts(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """``(*keys, block, bits)``: the set of ``index`` numbers of each key."""
    at = F.col(index).cast("long")
    return (rows.select(*keys, F.call_function("bitmap_bucket_number", at).alias("block"),
                        F.call_function("bitmap_bit_position", at).alias("bit"))
            .groupBy(*keys, "block").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits")))


def distinct_counts(parts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``(*keys, out)``: exact distinct counts of the united sets."""
    united = parts.groupBy(*keys, "block").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))
    return united.groupBy(*keys).agg(F.sum(F.call_function("bitmap_count", F.col("bits"))).alias(out))
