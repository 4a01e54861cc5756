"""Content digests of tables: a count and two sums of row hashes.

A digest does not depend on the order of rows, files or columns, and adds up
over parts of a table.  Rows count as often as they occur.  Every column
enters with its name, its value and whether it is null, so that a value moved
to another column, or a null in place of it, changes the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = "decimal(28,0)"  # 64-bit hashes, of which a sum has room for 10^10 times as many digits


def row_hash(columns: list[str], salt: int) -> Column:
    """A row's 64-bit hash; ``salt`` gives another one of the same row."""
    parts: list[Column] = [F.lit(salt)]
    for name in sorted(columns):
        col = F.col(f"`{name}`")
        parts += [F.lit(name), col.isNull(), col]
    return F.xxhash64(*parts)


def content_digests(df: DataFrame, part: str | None = None) -> DataFrame:
    """``(part, rows, digest)`` a value of the column ``part`` (as text), or one
    row with a null ``part`` for the whole table."""
    value = F.lit(None).cast("string") if part is None else F.col(f"`{part}`").cast("string")
    hashed = df.select(value.alias("part"), *[row_hash(df.columns, s).cast(_WIDE).alias(f"h{s}") for s in (1, 2)])
    sums = [F.coalesce(F.sum(f"h{s}"), F.lit(0)).cast("string") for s in (1, 2)]
    out = [F.count(F.lit(1)).alias("rows"), F.concat_ws(":", *sums).alias("digest")]
    if part is None:
        return hashed.agg(*out).select(F.lit(None).cast("string").alias("part"), "rows", "digest")
    return hashed.groupBy("part").agg(*out)
