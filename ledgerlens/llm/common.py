"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Largest frame that an operator broadcasts by its own decision, measured
# (not estimated) before the hint is given; larger frames take a shuffle join.
BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.  Only where
    that is unset (local tests) a scratch folder takes its place."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="llm-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.  Cuts the
    lineage: a lost executor costs a re-read, not the work before it."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is within ``limit``:
    64 bytes a row and the length of the row as text.  Otherwise ``df`` as it
    is, for a shuffle join."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n = df.agg(F.sum(64 + F.coalesce(row, F.lit(0))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if n <= limit else df


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` does just that to a text of
    ASCII alone, and much faster)."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def doc_key(doc_id: Column, tie: Column) -> Column:
    """What tells documents apart in joins: the id and a hash of the text.  A
    null id is one of its own; no field is null, so that keys compare equal."""
    return F.struct(F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("id"),
                    doc_id.isNull().alias("anonymous"), tie.alias("tie"))


def key_id(key: str) -> Column:
    """The id of a ``doc_key``, null again where it was."""
    return F.when(~F.col(f"{key}.anonymous"), F.col(f"{key}.id"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where
    ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: its 0-based place in ``order``, without a window
    over all rows.  Rows are range-partitioned and sorted; their partition and
    place in it are written to the shared folder, so that a repeated task sees
    the same ones; each partition's first rank comes from a count a
    partition.  Rows that tie in ``order`` get ranks in any order."""
    tagged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("__at", 33)
    counts = tagged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part")) - F.col("__n")
    first = maybe_broadcast(counts.select("__part", before.alias("__first")))
    place = F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (tagged.withColumn("__part", part).join(first, "__part").withColumn(out, place)
            .drop("__at", "__part", "__first"))
