from ledgerlens.functions.bucket import raw_bucket, bucket100
from ledgerlens.functions.calendar import month_str, month_end
from ledgerlens.functions.measures import (
    round_half_up_double,
    sum_if,
    weighted_ratio,
    safe_ratio,
    to_money,
)

__all__ = [
    "raw_bucket",
    "bucket100",
    "month_str",
    "month_end",
    "round_half_up_double",
    "sum_if",
    "weighted_ratio",
    "safe_ratio",
    "to_money",
]
