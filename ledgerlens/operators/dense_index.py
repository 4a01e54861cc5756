"""Global dense row number without a single-partition window.

``row_number() over (order by k)`` with no partition clause makes Spark move
every row into one task.  Here the rows are range-partitioned on ``k`` and
sorted inside each partition; ``monotonically_increasing_id`` then encodes
(partition index, position in partition).  A per-partition count (one row
per partition, so its size is bounded by the partition count) gives each
partition its offset, which is broadcast back.  The tagged frame is
checkpointed to the shared checkpoint folder first, so the ids used for the
counts and for the final numbering are the same even if a task is re-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_POS_BITS = 33  # monotonically_increasing_id: upper 31 bits partition, lower 33 position


def dense_index(df: DataFrame, order_col: str, out_col: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ascending ``order_col`` order.

    ``order_col`` must be unique (the callers pass distinct ids).
    """
    spark = df.sparkSession
    n = num_partitions or spark.sparkContext.defaultParallelism
    tagged = (df.repartitionByRange(n, F.col(order_col))
                .sortWithinPartitions(order_col)
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    tagged = (tagged.withColumn("_pid", F.shiftrightunsigned("_mid", _POS_BITS))
                    .withColumn("_pos", F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out_col, (F.col("_off") + F.col("_pos") + 1).cast("bigint"))
                  .drop("_mid", "_pid", "_pos", "_off"))
