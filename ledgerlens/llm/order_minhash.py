"""Document fingerprints: Order MinHash.

A text is a sequence of words; its k-mers are runs of ``K`` words, and the
n-th k-mer of one kind in the text is told apart from the others by n
(occurrence number).  Numbered k-mers are dealt by hash to ``BINS`` bins (one
permutation in place of as many hash functions).  Each bin selects its ``PICK``
minimal ones, puts them back in text order and hashes the tuple.  Two texts
share a tuple only where the same k-mers are minimal in the same order, so the
share of equal tuples falls with the edit distance, moved passages included.

``signature`` is one array expression a document: no k-mer leaves its row, so
nothing is shuffled for it, and repeated k-mers are numbered after a sort
inside the row.

Defined results: a null text is an empty one; a text without words has no
tuples and the fingerprint ""; a text of fewer than ``K`` words is one k-mer;
a text of more k-mers than ``POS_BITS`` can place is an error;
two texts without words are alike (1.0), with and without are not (0.0).
Documents are ordered by id, then hash of the text; rows that repeat both
count as one document and get the same row each; a null id is the smallest; of
a single document the next one is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import doc_key, key_id, let, materialize, rank_rows, table

K = 2
BIN_BITS = 5
BINS = 1 << BIN_BITS
PICK = 2
POS_BITS = 26  # words of the longest text: 67 million
POS_MASK = (1 << POS_BITS) - 1
RANK_BITS = 63 - BIN_BITS - POS_BITS


def _hashes(text: Column) -> Column:
    """Hash of each word."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _kmers(h: Column) -> Column:
    """Hash of each k-mer, in text order."""
    n = F.size(h)
    many = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)]))
    return F.when(n >= K, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def _placeable(g: Column) -> Column:
    """``g``, or an error where a place in it needs more than ``POS_BITS``."""
    error = F.raise_error(F.lit(f"a text has more than {POS_MASK + 1} k-mers, whose places are not told apart"))
    return F.when(F.size(g) > POS_MASK + 1, error).otherwise(g)


def _kind(v: Column) -> Column:
    return v.bitwiseAND(F.lit(~POS_MASK))


def _place(v: Column) -> Column:
    return v.bitwiseAND(F.lit(POS_MASK))


def _numbered(v: Column, occurrence: Column) -> Column:
    """Bin, rank in the bin and place of a k-mer's n-th occurrence, packed in
    that order."""
    x = F.xxhash64(_kind(v), occurrence)
    return F.shiftleft(F.shiftrightunsigned(x, 64 - BIN_BITS - RANK_BITS), POS_BITS).bitwiseOR(_place(v))


def _occurrences(s: Column) -> Column:
    """``s``: k-mers as (kind, place), sorted.  Kinds that occur once are
    numbered 0; the others by their place in their run."""
    n = F.size(s)

    def same(i: Column, j: Column) -> Column:
        return F.coalesce(_kind(F.get(s, i)) == _kind(F.get(s, j)), F.lit(False))

    def repeated(i: Column) -> Column:
        return ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1))

    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    single = F.transform(F.filter(every, lambda i: ~repeated(i)), lambda i: _numbered(F.get(s, i), F.lit(0)))

    def runs(begins: Column) -> Column:
        def run(b: Column, j: Column) -> Column:
            # a run ends before the next run's begin, or where the kind changes
            limit = F.coalesce(F.get(begins, j + 1), n) - 1
            inside = F.filter(F.sequence(b, limit), lambda i: same(i, b))
            return F.transform(inside, lambda i: _numbered(F.get(s, i), i - b))
        return F.flatten(F.transform(begins, run))

    begins = F.filter(every, lambda i: repeated(i) & ((i == 0) | ~same(i, i - 1)))
    return F.concat(single, let(begins, runs))


def _tuples(t: Column, g: Column) -> Column:
    """``t``: numbered k-mers, sorted.  The tuple of each bin that has any, as
    bin and 32-bit hash."""
    shift = RANK_BITS + POS_BITS

    def bin_of(v: Column) -> Column:
        return F.shiftrightunsigned(v, shift)

    minimal = F.filter(t, lambda v, i: (i < PICK) | (bin_of(F.get(t, i - PICK)) != bin_of(v)))

    def by_bin(kept: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(kept) - 1),
                         lambda i: (i == 0) | (bin_of(F.get(kept, i)) != bin_of(F.get(kept, i - 1))))

        def one(i: Column) -> Column:
            b = bin_of(F.get(kept, i))
            own = F.filter(F.slice(kept, i + 1, PICK), lambda v: bin_of(v) == b)
            places = F.array_sort(F.transform(own, _place))
            hashed = F.aggregate(places, F.xxhash64(b), lambda acc, p: F.xxhash64(acc, F.get(g, p.cast("int"))))
            return F.shiftleft(b, 32).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 32) - 1)))

        return F.transform(heads, one)

    return F.when(F.size(t) > 0, let(minimal, by_bin)).otherwise(F.array().cast("array<bigint>"))


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the tuples of the column ``text``, as an array of
    longs."""
    g, s, t = f"{out}__g", f"{out}__s", f"{out}__t"
    return (df.withColumn(g, let(let(_hashes(F.col(text)), _kmers), _placeable))
            .withColumn(s, F.sort_array(F.transform(g, lambda x, i: _kind(x).bitwiseOR(i.cast("long")))))
            .withColumn(t, F.sort_array(_occurrences(F.col(s))))
            .withColumn(out, _tuples(F.col(t), F.col(g))).drop(g, s, t))


def fingerprint_text(sig: Column) -> Column:
    """Ten hex digits a tuple: bin and hash."""
    return F.lower(F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v), 10, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either has."""
    bins = F.array_union(F.transform(a, lambda v: F.shiftrightunsigned(v, 32)),
                         F.transform(b, lambda v: F.shiftrightunsigned(v, 32)))
    return F.when(F.size(bins) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(bins))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """``(doc, text, n_chars, times, next, edited)`` of each distinct document of
    ``docs`` (``doc``, ``text``): the last third of its code points replaced by
    the first as many of the next one by descending id.

    Neighbours are found on the narrow keys; then each document sends its
    neighbour no more than the prefix that it needs."""
    sized = (docs.select("doc", F.char_length("text").cast("long").alias("n_chars"))
             .groupBy("doc", "n_chars").agg(F.count(F.lit(1)).cast("int").alias("times")))
    ranked = materialize(rank_rows(sized, [F.col("doc.anonymous").desc(), F.col("doc.id").asc(), F.col("doc.tie").asc()], "rank"), "order")
    n, most = ranked.agg(F.count(F.lit(1)), F.max("times")).first()
    donors = ranked.select(F.col("doc").alias("next"), (F.when(F.col("rank") == n - 1, 0)
                                                        .otherwise(F.col("rank") + 1)).alias("rank"))
    # the next by descending id has the rank below; that of the smallest is the largest
    pairs = ranked.join(donors, "rank").select("doc", "n_chars", "times", "next",
                                               F.floor(F.col("n_chars") / 3).cast("int").alias("cut"))
    once = docs.dropDuplicates(["doc"]) if (most or 0) > 1 else docs
    needs = pairs.withColumnRenamed("doc", "receiver").withColumnRenamed("next", "doc")
    given = (once.join(needs, "doc")
             .select("receiver", F.col("doc").alias("next"), "n_chars", "times", "cut",
                     F.substring("text", F.lit(1), F.col("cut")).alias("given")))
    return (once.join(given.withColumnRenamed("receiver", "doc"), "doc")
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")),
                                           "given"))
            .select("doc", "text", "n_chars", "times", "next", "edited"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        doc_key(F.col("doc_id"), F.xxhash64("text")).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"))
    pairs = edited_pairs(docs)
    signed = with_signature(with_signature(pairs, "text", "sig"), "edited", "edited_sig")
    done = materialize(signed.select("doc", "next", "n_chars", "times", F.sha2("edited", 256).alias("edited_sha256"),
                                     "sig", "edited_sig"), "signatures")
    others = done.select(F.col("doc").alias("next"), F.col("sig").alias("next_sig"))
    return (done.join(others, "next")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
            .select(key_id("doc").alias("doc_id"), "n_chars", "edited_sha256", fingerprint_text(F.col("sig")).alias("fingerprint"),
                    fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"),
                    likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                    likeness(F.col("sig"), F.col("next_sig")).alias("near_next")))
