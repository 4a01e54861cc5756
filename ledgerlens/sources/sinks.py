"""Sinks: bundle the curated objects to another location with a row-count audit.

A bundle is a parquet copy of every curated object (the same job serves a
copy to another region or account: only the target path differs).  The
audit counts rows of the written copy, so it proves what landed.  Data
never passes through the driver.

``bundle_digests`` tells bundles apart by content, and ``sync_bundle`` copies
only the objects and months whose content differs.  Item tables lie in folders
by invoice month (``PARTS``).
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.digests import content_digests
from ledgerlens.plans.lineage import BUNDLE

# Objects that are copied by parts, and the column of these.
PARTS = {"ar_items": "invoice_month", "ap_items": "invoice_month"}
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # folder name of a null


def _write(df: DataFrame, path: str, part: str | None, parts: list[str | None] | None = None) -> None:
    """``df`` written over ``path``; with ``parts``, over these parts alone."""
    if part is None:
        df.write.mode("overwrite").parquet(path)
        return
    if parts is not None:
        df = df.filter(F.coalesce(F.col(part), F.lit(_NO_VALUE)).isin([p or _NO_VALUE for p in parts]))
    (df.hint("rebalance", part).write.mode("overwrite").partitionBy(part)
     .option("partitionOverwriteMode", "static" if parts is None else "dynamic").parquet(path))


def read_object(spark, folder: str, name: str) -> DataFrame:
    """An object of the bundle in ``folder``; a part column is text."""
    path = os.path.join(folder, name)
    df = spark.read.parquet(path)
    if name not in PARTS:
        return df
    fields = [T.StructField(f.name, T.StringType()) if f.name == PARTS[name] else f for f in df.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def bundle_digests(spark, folder: str, objects: list[str] | None = None) -> DataFrame:
    """``(object, part, rows, digest)`` of the bundle in ``folder``."""
    return reduce(DataFrame.unionByName, [
        content_digests(read_object(spark, folder, name), PARTS.get(name)).select(F.lit(name).alias("object"), "*")
        for name in objects or BUNDLE])


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _remove(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sync_bundle(spark, source: str, target: str, objects: list[str] | None = None) -> DataFrame:
    """Make ``target`` equal to ``source``: parts whose digest differs are
    copied, parts that the source no longer has are removed.  Returns
    ``(object, part, action)`` with ``copied``, ``removed`` or ``same``.  What
    reaches the driver is a row a part (objects and months).  An object is
    written as ``copy_bundle`` does, not as one transaction; a run that broke
    off is mended by the next one, since it compares what is there."""
    done = []
    for name in objects or BUNDLE:
        path, part = os.path.join(target, name), PARTS.get(name)
        # an interrupted first copy leaves a folder that has no finished write
        there = _exists(spark, os.path.join(path, "_SUCCESS"))
        want = {r["part"]: (r["rows"], r["digest"]) for r in bundle_digests(spark, source, [name]).collect()}
        have = ({r["part"]: (r["rows"], r["digest"]) for r in bundle_digests(spark, target, [name]).collect()}
                if there else {})
        gone = [p for p in have if p not in want]
        changed = [p for p in want if have.get(p) != want[p]]
        df = read_object(spark, source, name)
        if not there:
            _write(df, path, part)
        elif changed:
            _write(df, path, part, changed)
        for p in gone if part else []:
            _remove(spark, os.path.join(path, f"{part}={p or _NO_VALUE}"))
        done += [(name, p, "copied" if p in changed or not there else "same") for p in want]
        done += [(name, p, "removed") for p in gone]
    return spark.createDataFrame(done, "object string, part string, action string")


def write_bundle(wh, target: str, objects: list[str] | None = None) -> DataFrame:
    spark = wh.spark
    audits = []
    for name in objects or BUNDLE:
        path = os.path.join(target, name)
        _write(getattr(wh, name), path, PARTS.get(name))
        audits.append(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
                      .select(F.lit(name).alias("object"), "rows"))
    return reduce(DataFrame.unionByName, audits)


def copy_bundle(spark, source: str, target: str, objects: list[str] | None = None) -> DataFrame:
    """Copy a written bundle to another location (columnar files in, files out)."""
    audits = []
    for name in objects or BUNDLE:
        _write(read_object(spark, source, name), os.path.join(target, name), PARTS.get(name))
        audits.append(spark.read.parquet(os.path.join(target, name)).agg(F.count(F.lit(1)).alias("rows"))
                      .select(F.lit(name).alias("object"), "rows"))
    return reduce(DataFrame.unionByName, audits)
