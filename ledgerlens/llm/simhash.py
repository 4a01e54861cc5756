"""SimHash near-dedup: pigeonhole blocks.

A text's words (lower-cased A-Z, cut at ASCII white space) give shingles of
``k`` words, repeats included; each is hashed with XXH64 (seed 42).  A bit of
the fingerprint is 1 if it is set in more than half of the hashes.  Two
documents are linked if their fingerprints differ in at most ``max_bits`` bits;
the classes are the connected components of the links.

Links: the fingerprint is split into ``BLOCKS`` blocks.  Two fingerprints that
differ in at most d bits agree in at least BLOCKS - d blocks, so every choice
of BLOCKS - d blocks is a key; fingerprints that share a key are candidates and
the Hamming distance decides.  Work is on distinct fingerprints only, so exact
copies cost nothing here.

A crowded key (over ``CROWD`` different fingerprints, as in a large group of
near copies) is not paired out.  Its fingerprints are expanded once to
all words within max_bits / 2 flips; two of them share such a word exactly if
they differ in at most max_bits bits, so those that share one are linked to
the least of them.  That is linear in the group and loses no link.

Defined results: a null or empty text has no words and fingerprint zero, and is
linked like any other; a text of fewer than ``k`` words is one shingle;
repeated rows get the same class; a class whose ids are all null has a null
class id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import doc_key, materialize, maybe_broadcast, table
from ledgerlens.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BLOCKS = 4
CROWD = 64
SLICE_BYTES = 1 << 20
KEY = "__document_key"

LANES = 16
LANE_MASK = np.uint64(0x0001000100010001)
LANE_LIMIT = (1 << 16) - 1


def shingle_hashes(text: str | None, k: int = SHINGLE) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) < k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``counts`` hashes.  Bits are counted in
    16-bit lanes, four of the 64 bits at a time; runs are cut so that no lane
    overflows."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begin = (np.cumsum(counts) - counts)[full]
    pieces = -(-counts[full] // LANE_LIMIT)
    of = np.repeat(np.arange(len(full)), pieces)
    first = np.cumsum(pieces) - pieces
    cuts = begin[of] + (np.arange(len(of)) - first[of]) * LANE_LIMIT
    for lane in range(LANES):
        sums = np.add.reduceat((hashes >> np.uint64(lane)) & LANE_MASK, cuts)
        for j in range(4):
            ones = np.add.reduceat((sums >> np.uint64(16 * j)) & np.uint64(LANE_LIMIT), first)
            out[full] |= (2 * ones > counts[full].astype(np.uint64)).astype(np.uint64) << np.uint64(16 * j + lane)
    return out


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(size):
                before = int(size[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
                rows = batch.slice(at, to - at)
                at = to
                hashes = [np.array(shingle_hashes(t, k), dtype=np.uint64) for t in rows.column("text").to_pylist()]
                prints = majority_bits(np.concatenate(hashes), np.array([len(h) for h in hashes], dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("tie"), pa.array(prints.view(np.int64), pa.int64())],
                    names=["doc_id", "tie", "fp"])
    return run


def fingerprint(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tie, fp)``, one row per document; ``tie`` is a hash of the
    text, to tell apart rows of one id.  Written to the shared folder, since
    the texts should be read once."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"),
                        F.col(text_col).cast("string").alias("text"))
    return materialize(keyed.mapInArrow(_fingerprints(k), "doc_id long, tie long, fp long"), "simhash")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(max_bits: int, blocks: int = BLOCKS) -> list[int]:
    """A bit mask for each choice of ``blocks - max_bits`` of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [_signed(sum(c)) for c in combinations(block, blocks - max_bits)]


def links(prints: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) of at
    most ``max_bits`` differing bits.  In crowded keys the links are stars that
    connect the same classes."""
    if max_bits not in (0, 2):
        raise ValueError("max_bits must be 0 or 2")
    if max_bits == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter(F.lit(False))
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                               for t, m in enumerate(block_masks(max_bits))]))
    entries = prints.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    shared = entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    candidates = materialize(entries.join(shared, ["t", "key"]), "blocks")

    few = candidates.filter(F.col("n") <= crowd)
    left, right = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, ["t", "key"]).filter((F.col("a") < F.col("b")) & (apart <= max_bits)).select("a", "b")

    crowded = candidates.filter(F.col("n") > crowd).select("fp").distinct()
    flips = [0] + [_signed(1 << i) for i in range(64)]
    near = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("word"))
    least = near.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    stars = near.join(least, "word").filter(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints`` (``doc_id``, ``tie``, ``fp``) with ``root`` (the class)
    and ``component_id`` (its smallest doc_id)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(links(nodes.select("fp"), max_bits))
    rooted = (nodes.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(ids, "root"), "fp")


def survivors(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One document of each class, the one of the smallest id, with all the
    columns of ``docs``.  Among rows of that id the one with the least hash of
    its text stays; of rows that repeat id and text, the least in the order of
    all columns.  A row with a null id stays only where its class has no other."""
    found = classes(fingerprint(docs, k, id_col, text_col), max_bits)
    keep = (found.groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("k")))
    kept = keep.select(doc_key(F.col("k.doc_id"), F.col("k.tie")).alias("kept"))
    counted = found.groupBy(doc_key(F.col("doc_id"), F.col("tie")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    judged = counted.join(kept, F.col("key") == F.col("kept"), "left")
    # what does not simply stay: other members of a class, and rows that repeat the one that stays
    rest = materialize(judged.filter("kept is null or n > 1").select(F.col("key").alias("__key"), "kept"), "rest")
    marked = docs.withColumn(KEY, doc_key(F.col(id_col), F.xxhash64(F.col(text_col))))
    small = maybe_broadcast(rest.select("__key"))
    out = marked.join(small, marked[KEY] == small["__key"], "left_anti").drop(KEY)
    again = rest.filter("kept is not null")
    if again.isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    many = marked.join(again.select("__key"), F.col(KEY) == F.col("__key"), "left_semi")
    return out.unionByName(many.groupBy(KEY).agg(F.min(row).alias("r")).select("r.*"))


def op9_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(fingerprint(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
