"""Deterministic demo bucket.

The enrichment columns (terms, delays, programs, segments) are driven by a
stable 0..99 bucket of a few key columns.  The bucket is the first 32 bits of
an MD5 digest of the '|'-joined values, read as an unsigned integer, so any
engine with ``md5`` computes the same number (the DuckDB oracle does).
It is a pure per-row expression, evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_bucket(*cols) -> Column:
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def bucket100(*cols) -> Column:
    return (raw_bucket(*cols) % 100).cast("int")
