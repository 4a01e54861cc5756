"""Sharding: hierarchical weighted hash tree.

The tree has regions, racks and shards; a node weighs as much as its shards.  A
row descends: at each level every child draws -ln(u) / weight, with u in (0, 1)
hashed from the row's key and the child, and the least draw wins, so that a
child gets rows in proportion to its weight.  The draw of one child does not
depend on the others: a changed weight moves rows only into the subtrees that
grew or out of those that shrank, and rows elsewhere stay.

``grow`` puts a new shard in a region of its own.  Then the new region is the
only subtree whose weight changes, and rows move to the new shard and nowhere
else; this is the law ``key``: id and number of shards decide.

All of it is DataFrame functions, and ``assign`` shuffles nothing.  Slots are
numbered by a distributed rank, not by a window over a shard.

Defined results: a null id is replaced by the hash of its text, so that many
such rows spread; a null text has no bytes and the crc32 0; rows of one id get
the same shard and slots of their own, repeated rows too; an empty table gives
no rows; ``assign`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import maybe_broadcast, rank_rows, table

SHARDS = 24
SHARDS_PER_RACK = 4
RACKS_PER_REGION = 3
ROW_BYTES = 8


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def build(shards: int, base: int = SHARDS) -> list[Leaf]:
    """A tree of ``shards`` equal shards: ``base`` of them in full racks and
    regions, each further one in a region of its own."""
    first = [Leaf(s // (SHARDS_PER_RACK * RACKS_PER_REGION), s // SHARDS_PER_RACK, s) for s in range(min(shards, base))]
    return grow(first, shards - len(first))


def grow(tree: list[Leaf], by: int = 1, weight: float = 1.0) -> list[Leaf]:
    """``tree`` with ``by`` more shards, each in a new region."""
    out = list(tree)
    for _ in range(by):
        out.append(Leaf(max((x.region for x in out), default=-1) + 1, max((x.rack for x in out), default=-1) + 1,
                        max((x.shard for x in out), default=-1) + 1, weight))
    return out


def _children(tree: list[Leaf], parent: str | None, child: str) -> dict[int, list[tuple[int, float]]]:
    """Per parent: its children and their weights."""
    out: dict[int, dict[int, float]] = {}
    for x in tree:
        kids = out.setdefault(getattr(x, parent) if parent else 0, {})
        kids[getattr(x, child)] = kids.get(getattr(x, child), 0.0) + x.weight
    return {p: sorted(kids.items()) for p, kids in out.items()}


def _winner(key: Column, level: int, kids: Column) -> Column:
    """The child of least draw; ``kids`` is an array of (id, weight)."""
    bits = lambda c: F.shiftrightunsigned(F.xxhash64(key, F.lit(level), c["id"]), 11)
    draw = lambda c: F.struct((-F.ln((bits(c) + 0.5) / float(1 << 53)) / c["weight"]).alias("draw"),
                              c["id"].alias("id"))
    return F.array_min(F.transform(kids, draw))["id"]


def _level(tree: list[Leaf], parent: str | None, child: str) -> Column:
    """Literal array by parent number of the arrays of its children."""
    kids = _children(tree, parent, child)
    node = lambda i, w: F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight"))
    none = F.array().cast("array<struct<id:int,weight:double>>")
    return F.array(*[F.array(*[node(i, w) for i, w in kids[p]]) if p in kids else none
                     for p in range(max(kids) + 1)])


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key (any type)."""
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    at: Column = F.lit(0)
    for level, (parent, child) in enumerate(((None, "region"), ("region", "rack"), ("rack", "shard"))):
        at = _winner(key, level, F.get(_level(live, parent, child), at))
    return at


def assign(df: DataFrame, key: Column, tree: list[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; nothing moves."""
    return df.withColumn(out, shard_of(key, tree))


def number_slots(df: DataFrame, order: list[Column], shard: str = "shard", out: str = "slot") -> DataFrame:
    """``df`` with a gapless 0-based number inside each shard, in ``order``."""
    ranked = rank_rows(df, [F.col(shard), *order], "__rank")
    first = ranked.groupBy(F.col(shard).alias("__shard")).agg(F.min("__rank").alias("__first"))  # a row a shard
    small = maybe_broadcast(first)
    return (ranked.join(small, ranked[shard] == small["__shard"])
            .withColumn(out, F.col("__rank") - F.col("__first")).drop("__rank", "__shard", "__first"))


def op1_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = build(SHARDS)
    raw = F.col("text").cast("binary")
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(raw), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"))
    placed = assign(assign(narrow, F.col("key"), tree), F.col("key"), grow(tree), "grown_shard")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    return (number_slots(placed, order)
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    F.col("slot").cast("long").alias("slot"), "grown_shard"))
