"""Calendar helpers ('YYYY-MM' month strings, month ends, weeks)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_RE = re.compile(r"^\d{4}-(0[1-9]|1[0-2])$")


def month_str(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM")


def month_end(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.last_day(c)


def prior_year_month(m: str) -> str:
    """'YYYY-MM' twelve months earlier."""
    return f"{int(m[:4]) - 1}{m[4:]}"


def first_month_end_after(c) -> Column:
    """First month end strictly after date ``c``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.last_day(F.date_add(c, 1))
