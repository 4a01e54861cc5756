"""Benchmark decontamination: a distributed positional inverted index.

A benchmark text ("phrase") has as windows its runs of ``WINDOW`` consecutive
words (a shorter phrase is one window).  A window is found by its rarest words:

1. ``split_words``: every text is split once, and its words' hashes are stored;
   all that follows reads those.
2. ``term_counts``: how often each benchmark word occurs in all documents.  The
   words of a document are joined map-side to the benchmark's vocabulary, so
   the shuffle holds one partial count per word and task.
3. ``anchors``: each window keeps the places of its ``ANCHORS`` rarest pairs
   of neighbours; a pair is as rare as its rarer word.
4. ``postings``: those (document, pair, position) of the anchor pairs only,
   written to the shared folder.  Keying a posting by the word and the next one
   intersects the two lists of a pair where the text is read.
5. ``candidates``: the postings of a window's anchors, moved back by their
   place in the phrase, meet in (document, window, offset); a window whose
   anchors are all there is a candidate.  A frequent word never gathers its
   postings in one task, since they are grouped by document and offset.
6. ``phrase_matches``: candidates are compared word by word with the text of
   the few documents that have any.

A proximity match is a place that has a window's words in any order, one of
many left out if need be (``near_windows``).  It is found in the pass that
reads the postings, where the words around a place are at hand.  ``op10`` gives
the items met so as columns of their own; an exact match is one of them.  What
counts as contaminated, and goes in ``drop_contaminated``, is exact matches.

Words are looked up by their 64-bit hash, and compared as text in the end (by
hash alone in proximity matches).  All of it is DataFrame functions.  Frames
that follow the benchmark's size are broadcast only after their size was
measured, and joined by shuffle beyond it.  The words of the corpus then pass a
bitmap of fixed size first (``_sift``), so that what is shuffled is what may be
wanted and not every word.

Documents are told apart by id and hash of the text.  Defined results: a null
text has no words, and so no hit; rows that repeat id and text get the same
row each; rows of one id with different texts are judged apart; a null item id
is the item ``null``; an item without words has no window; an empty benchmark
hits nothing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import doc_key, key_id, lower_ascii, materialize, maybe_broadcast, table

WINDOW = 10
ANCHORS = 2
# A window of so many different words may lack one of them in a proximity match.
LOOSE = 8
# Bits of the bitmap that words pass where what is wanted is too large to
# broadcast: 16 MB in rows of 4 KB, whatever the benchmark's size.
SIFT_BITS = 1 << 27
SIFT_ROW = 1 << 15
# A word is a run of these characters (A-Z are lower case by
# then), which are all but \x00-\x2F, \x3A-\x60 and \x7B-\x7F.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text.cast("string")), F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, text)``: ``doc`` is the id with a hash of the text."""
    return docs.select(doc_key(F.col(id_col), F.xxhash64(F.col(text_col))).alias("doc"),
                       F.col(text_col).cast("string").alias("text"))


def phrases(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, pid, words)`` of the items that have words; items of the same
    words share ``pid``."""
    found = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                             words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    return found.select("item", F.xxhash64("words").alias("pid"), "words").distinct()


def places(ph: DataFrame) -> DataFrame:
    """``(pid, place, term)`` of every word of every phrase; a term is the
    word's 64-bit hash."""
    return (ph.select("pid", "words").distinct().select("pid", F.posexplode("words").alias("place", "word"))
            .select("pid", "place", F.xxhash64("word").alias("term")))


def split_words(docs: DataFrame) -> DataFrame:
    """``(doc, n_words, h)``, stored: the hashes of a text's words in order."""
    hashes = docs.select("doc", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    return materialize(hashes.select("doc", F.size("h").cast("long").alias("n_words"), "h"), "words")


def term_counts(split: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n)``: occurrences of the terms in all texts of ``split``."""
    known = maybe_broadcast(terms.select("term").distinct())
    return (split.select(F.explode("h").alias("term")).join(known, "term").groupBy("term")
            .agg(F.count(F.lit(1)).alias("n")))


def _window_places(terms: DataFrame, window: int) -> DataFrame:
    """``(pid, length, start, place)`` of every word of every window."""
    size = terms.groupBy("pid").agg(F.count(F.lit(1)).cast("int").alias("size"))
    length = F.least(F.lit(window), F.col("size"))
    return (size.select("pid", length.alias("length"), F.explode(F.sequence(F.lit(0), F.col("size") - length))
                        .alias("start"))
            .select("pid", "length", "start",
                    F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place")))


def anchors(terms: DataFrame, counts: DataFrame, window: int = WINDOW, k: int = ANCHORS) -> DataFrame:
    """``(pid, start, length, places)``: each window and the places of its
    ``k`` rarest pairs (of the first word of each).  A window with a word that
    no document has is left out."""
    windows = _window_places(terms, window)
    here = terms.join(counts, "term").select("pid", "place", "n")
    after = here.select("pid", (F.col("place") - 1).alias("place"), F.col("n").alias("n_next"))
    known = windows.join(here, ["pid", "place"]).join(after, ["pid", "place"], "left")
    last = F.col("place") == F.col("start") + F.col("length") - 1
    every = W.partitionBy("pid", "start")
    # the last word begins no pair, but stands for a window of one word
    pairs = (known.withColumn("found", F.count(F.lit(1)).over(every)).filter("found = length")
             .filter(~last | (F.col("length") == 1)).withColumn("rarity", F.least("n", "n_next")))
    rare = (pairs.withColumn("rank", F.row_number().over(every.orderBy("rarity", "place")))
            .filter(F.col("rank") <= k))
    return rare.groupBy("pid", "start", "length").agg(F.array_sort(F.collect_list("place")).alias("places"))


def anchor_keys(windows: DataFrame, terms: DataFrame) -> DataFrame:
    """``(pid, place, single, key)`` of the anchors: ``key`` is the pair's
    hash, or the term for a window of one word (``single``)."""
    second = terms.select("pid", (F.col("place") - 1).alias("place"), F.col("term").alias("next"))
    key = F.when(F.col("single"), F.col("term")).otherwise(F.xxhash64("term", "next"))
    return (windows.select("pid", (F.col("length") == 1).alias("single"), F.explode("places").alias("place"))
            .distinct().join(terms, ["pid", "place"]).join(second, ["pid", "place"], "left")
            .select("pid", "place", "single", key.alias("key")))


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(SIFT_BITS))


def _sift(looks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``looks`` without most rows whose key is not in ``wanted``, and with all
    whose key is: a bit per key modulo ``SIFT_BITS``, in rows of 512 longs."""
    bit = wanted.select(_bit(F.col("key")).alias("bit")).distinct()
    word = bit.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    row = word.groupBy((F.col("word") / (SIFT_ROW // 64)).cast("int").alias("row")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("word") % (SIFT_ROW // 64)).alias("at"), "bits")))
        .alias("found"))
    every = F.transform(F.sequence(F.lit(0), F.lit(SIFT_ROW // 64 - 1)),
                        lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0).cast("long")))
    rows = F.broadcast(materialize(row.select("row", every.alias("bits")), "sift"))
    place = _bit(F.col("key"))
    bits = F.get("bits", (F.pmod(place, F.lit(SIFT_ROW)) / 64).cast("int"))
    return (looks.join(rows, (place / SIFT_ROW).cast("int") == rows["row"])
            .filter(F.getbit(bits, (F.pmod(place, F.lit(64))).cast("int")) == 1).drop("row", "bits"))


def postings(split: DataFrame, keys: DataFrame, near: DataFrame | None = None, within: int = WINDOW) -> DataFrame:
    """``(doc, key, pos, near_pid)``, stored.  Each word is looked up by its
    own hash (side 0) and by that of it and the next one (side 1), in one pass
    over the texts.  A row without ``near_pid`` is a posting of an anchor
    (``keys``).  One with it is a place that has a window's words, in any
    order, within ``within`` words before or after a word of ``near`` (from
    ``near_windows``).  A word's surroundings are cut from its own text once it
    is known to be wanted, or may be (``_sift``)."""
    every = split.select("doc", F.posexplode("h").alias("pos", "term"), "h")
    pair = F.xxhash64("term", F.get("h", F.col("pos") + 1))
    looks = every.select("doc", "pos", "h", F.posexplode(F.array("term", pair)).alias("side", "key"))
    wanted = keys.select("key", F.when(F.col("single"), 0).otherwise(1).alias("at"), F.lit(None).cast("long")
                         .alias("near_pid"), F.lit(0).alias("need"), F.lit(None).cast("array<bigint>").alias("terms"))
    if near is not None:
        wanted = wanted.unionByName(near.select("key", F.lit(0).alias("at"), F.col("pid").alias("near_pid"), "need",
                                                "terms"))
    stored = materialize(wanted.distinct(), "wanted")
    wanted = maybe_broadcast(stored)
    begin = F.greatest(F.col("pos") - within, F.lit(0))
    around = F.slice("h", begin + 1, F.col("pos") + within + 1 - begin)
    if wanted is stored:
        nearby = F.when(F.col("side") == 0, around)
        looks = _sift(looks, stored).select("doc", "pos", "side", "key", nearby.alias("around"))
        around = F.col("around")
    found = looks.join(wanted, "key").filter(F.col("side") == F.col("at"))
    whole = F.col("near_pid").isNull() | (F.size(F.array_intersect("terms", around)) >= F.col("need"))
    return materialize(found.filter(whole).select("doc", "key", "pos", "near_pid"), "postings")


def candidates(stored: DataFrame, keys: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc, pid, offset, start, length)``: windows all of whose anchors have
    a posting at the same offset (document position less place in the phrase)."""
    begun = windows.select("pid", "start", "length", F.size("places").alias("asked"), F.explode("places").alias("place"))
    looked = materialize(keys.drop("single").join(begun, ["pid", "place"]), "looked")
    offset = F.col("pos") - F.col("place")
    return (stored.join(maybe_broadcast(looked), "key").filter(offset + F.col("start") >= 0)
            .groupBy("doc", "pid", offset.alias("offset"), "start", "length", "asked")
            .agg(F.size(F.collect_set("place")).alias("met")).filter("met = asked").drop("met", "asked"))


def _with_words(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(doc, text_words)`` of the documents in ``keys``, once each."""
    few = docs.join(maybe_broadcast(keys), "doc", "left_semi")
    return few.groupBy("doc").agg(F.first("text").alias("text")).select("doc", words(F.col("text")).alias("text_words"))


def near_windows(terms: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(key, pid, start, need, terms)``: each window's different words, how
    many of them a place must have, and the word to look from.  ``LOOSE`` or
    more different words may lack one; the window is then looked for from its
    two rarest words, of which a place has one at least, else from the rarest.
    A word that no document has is the one lacking; with more of them the
    window is nowhere, and left out."""
    every = (_window_places(terms, window).join(terms, ["pid", "place"]).select("pid", "start", "term").distinct()
             .join(counts, "term", "left").groupBy("pid", "start")
             .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("w")))
    size = F.size("w")
    lacking = F.when(size >= LOOSE, 1).otherwise(0)
    absent = F.size(F.filter("w", lambda x: x["n"] == 0))
    return (every.filter(absent <= lacking)
            .select(F.explode(F.slice(F.col("w.term"), absent + 1, lacking - absent + 1)).alias("key"), "pid", "start",
                    (size - lacking).alias("need"), F.col("w.term").alias("terms")))


def matches(docs: DataFrame, ph: DataFrame, window: int = WINDOW, k: int = ANCHORS, within: int | None = None,
            split: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``(phrase_matches, proximity_matches)``, the latter only if ``within``
    is given: both take the same counts and the same pass over the words
    (``split``, from ``split_words``)."""
    split = split_words(docs) if split is None else split
    terms = materialize(places(ph), "terms")
    counts = materialize(term_counts(split, terms), "counts")
    windows = materialize(anchors(terms, counts, window, k), "windows")
    keys = materialize(anchor_keys(windows, terms), "anchors")
    near = None if within is None else near_windows(terms, counts, window)
    stored = postings(split, keys, near, within or 0)
    found = materialize(candidates(stored.filter("near_pid is null"), keys, windows), "candidates")
    texts = _with_words(docs, found.select("doc").distinct())
    part = F.slice("words", F.col("start") + 1, F.col("length"))
    asked = (found.join(maybe_broadcast(ph.select("pid", "words").distinct()), "pid")
             .select("doc", "pid", (F.col("offset") + F.col("start")).alias("pos"), "length", part.alias("asked")))
    exact = (asked.join(texts, "doc").filter(F.slice("text_words", F.col("pos") + 1, F.col("length")) == F.col("asked"))
             .select("doc", "pid", "pos", "length"))
    if within is None:
        return exact, None
    return exact, (stored.filter("near_pid is not null")
                   .select("doc", F.col("near_pid").alias("pid"), "pos").distinct())


def phrase_matches(docs: DataFrame, ph: DataFrame, window: int = WINDOW, k: int = ANCHORS) -> DataFrame:
    """``(doc, pid, pos, length)``: every place in ``docs`` (from ``keyed``)
    where a window of a phrase occurs word by word."""
    return matches(docs, ph, window, k)[0]


def proximity_matches(docs: DataFrame, ph: DataFrame, within: int = WINDOW, window: int = WINDOW) -> DataFrame:
    """``(doc, pid, pos)``: each place in ``docs`` (from ``keyed``) that has a
    window's words near one of its rarest, by ``near_windows``.  Windows are
    those of the exact search.  Words are told apart by their hash."""
    return matches(docs, ph, window, within=within)[1]


def _items(found: DataFrame, ph: DataFrame, name: str) -> DataFrame:
    """``(doc, name)``: the ids of the items met, sorted as strings."""
    named = found.select("doc", "pid").distinct().join(maybe_broadcast(ph.select("pid", "item")), "pid")
    return named.groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, within: int | None = None,
                  split: DataFrame | None = None) -> DataFrame:
    """``(doc, n_hit, n_items, items)`` of the documents that hold a window of
    an item: words hit, items met, their ids sorted as strings.  If ``within``
    is given, also ``near_items``, the ids of the items met by proximity, and
    the documents that have only such."""
    ph = materialize(phrases(benchmark), "phrases")
    exact, near = matches(docs, ph, window, within=within, split=split)
    exact = materialize(exact, "matches")
    end = F.col("pos") + F.col("length")
    so_far = F.max(end).over(W.partitionBy("doc").orderBy("pos", "length")
                             .rowsBetween(W.unboundedPreceding, -1))
    spans = exact.select("doc", "pos", "length").distinct().withColumn("covered", F.coalesce(so_far, F.lit(0)))
    hit = spans.groupBy("doc").agg(F.sum(F.greatest(end - F.greatest("pos", "covered"), F.lit(0))).alias("n_hit"))
    found = (hit.join(_items(exact, ph, "items"), "doc").select("doc", "n_hit", F.size("items").alias("n_items"), "items"))
    return found if near is None else found.join(_items(near, ph, "near_items"), "doc", "full")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that hold a window."""
    bad = materialize(contamination(keyed(docs), benchmark).select(F.col("doc").alias("leak")), "leaks")
    marked = docs.withColumn("__document_key", doc_key(F.col("doc_id"), F.xxhash64(F.col("text"))))
    bad = maybe_broadcast(bad)
    return marked.join(bad, marked["__document_key"] == bad["leak"], "left_anti").drop("__document_key")


def _sha256(items: str) -> Column:
    return F.sha2(F.concat_ws(",", F.coalesce(items, F.array().cast("array<string>"))), 256)


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents"))
    split = split_words(docs)
    found = contamination(docs, table(spark, sf_dir, "benchmark"), within=WINDOW, split=split)
    every = split.select("doc", "n_words")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (every.join(found, "doc", "left")
            .select(key_id("doc").alias("doc_id"), "n_words", hit.alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    _sha256("items").alias("items_sha256"), (hit > 0).alias("contaminated"),
                    F.coalesce(F.size("near_items"), F.lit(0)).cast("long").alias("n_near_items"),
                    _sha256("near_items").alias("near_items_sha256")))
