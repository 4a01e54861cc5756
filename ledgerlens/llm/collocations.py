"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

A text is cut into pieces, a piece into words; every word begins a suffix of up
to ``DEPTH`` words of its piece.  A phrase's count is the number of suffixes
that begin with it, and only phrases that occur ``least`` times matter.

1. ``vocabulary``: counts of all words.  A word's id is a 64-bit hash of
   language and word; ids are checked to be one to one over all words counted
   (another seed is taken if they are not), so that what follows is exact.
2. ``suffixes``: every suffix of two or more words as ids, cut at the first
   word that is not frequent, equal ones of a task's buffer collapsed to one
   with a count.  Stored in the shared folder.
3. ``route``: leading words are counted globally, first two of them.  Suffixes
   whose leading words are infrequent are abandoned, the rest cut at the first
   infrequent pair.  A leading pair that too many suffixes share is crowded:
   below it three leading words are counted, then four and so on, until no
   routing key is crowded.  Each suffix goes to
   the partition of its shortest uncrowded leading words, and so all suffixes
   that share those meet in one task; a crowded key is only ever counted.
   Before leading words are shuffled, ``sketch`` adds up their hashed counts: a
   place below ``least`` holds no frequent phrase, so what falls on it is left
   out (leading pairs) or cut off (three to ``DEPTH`` leading words).
4. ``frequent``: each task sorts pointers to its suffixes by a multikey
   three-way quicksort: a partition is split by the word at its depth into
   less, equal and greater; the weight of the equal part is the phrase's count,
   and the sort goes one word deeper in it.  A part that weighs less than
   ``least`` is abandoned unsorted.
5. ``collocations``: cuts, scores and nested phrases are joins of the frequent
   phrases with themselves, by id.

What is frequent or crowded is sent to the tasks as a bitmap of ``BITS`` places
(a Bloom filter of one hash): its size does not grow.  A place hit by chance
only sends a few suffixes further than needed; counts never change.  A sketch's
places grow with the suffixes up to ``2**SKETCH_BITS``.

Defined results: a null text is empty; a null language is ``und``; repeated
rows count each; a piece of one word has no phrase; ties of score and count go
by the phrase's UTF-8 bytes; an empty table has no phrases; extra columns are
ignored.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, maybe_broadcast, table

DEPTH = 5
LEAST = 100
TOP = 2000
NO_LANG = "und"
# Of a longer phrase's count in percent of the shorter's that makes it stand for it.
SHARE = 100
BITS = 25
SKETCH_BITS = 16, 27      # least and most
SKETCH_LOAD = 16          # suffixes a place of a sketch, about
SKETCH_ROWS = 1 << 21     # suffixes that a task adds up before it sends their places
BLOCK = 16                # bits of the places that are sent as one row
BUFFER = 1 << 20          # suffixes of a task that are collapsed at once
REMEMBERED = 400_000      # words and their ids that a task remembers
SLICE_BYTES = 1 << 20     # of a text that are split at once
PARTITION_ROWS = 1 << 20  # suffixes that a sorting task holds, about
COUNT_ROWS = 4 << 20      # suffixes whose leading words a task counts, about
# A-Z are lower-cased, these bytes end a piece, and a tab parts words as a space does.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = LOWER.translate(bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" "))

SUFFIX = [f"w{k}" for k in range(1, DEPTH + 1)]
SUFFIX_SCHEMA = ", ".join(f"{c} long" for c in SUFFIX) + ", n long"
COUNT_SCHEMA = "lang string, word string, n long"
BLOCK_SCHEMA = "depth int, block int, places binary"


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size; ``b"\\n"`` stands where a
    piece ends, empty words are to be left out."""
    raw = (text or "").encode().translate(TABLE)
    at = 0
    while at < len(raw):
        end = at + SLICE_BYTES
        if end < len(raw):     # not within a word, however long it is
            stops = [x for x in (raw.find(b" ", end), raw.find(b"\n", end)) if x >= 0]
            end = min(stops, default=len(raw))
        yield raw[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None]]:
    for batch in batches:
        lang, text = batch.column("lang"), batch.column("text")
        for at in range(batch.num_rows):
            yield lang[at].as_py(), text[at].as_py()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(b"", None)
            c.pop(b"\n", None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()),
                 pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    for lang, text in _texts(batches):
        for words in word_lists(text):
            counts.setdefault(lang, Counter()).update(words)
        if sum(map(len, counts.values())) > REMEMBERED:
            yield from out()
    yield from out()


def _spoken(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))


def word_id(seed: Column, mask: int) -> Column:
    """A word's id: XXH64 of seed, language and word in turn, never zero."""
    return F.xxhash64(seed, F.col("lang"), F.col("word")).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(1).cast("long"))


class Ids(dict):
    """``word -> id`` of one language, as ``word_id`` has it; 0 for words that
    the bitmap of frequent words does not have."""

    def __init__(self, lang: str, seed: str, mask: int, frequent: np.ndarray):
        super().__init__({b"": -1, b"\n": 0})
        self.start, self.mask, self.frequent = xxhash.xxh64_intdigest(lang, xxhash.xxh64_intdigest(seed, 42)), mask, frequent

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            kept = {w: x for w, x in self.items() if x}
            self.clear()
            if len(kept) < REMEMBERED // 2:
                self.update(kept)
            self[b""], self[b"\n"] = -1, 0
        value = xxhash.xxh64_intdigest(word, self.start) & self.mask | 1
        signed = value - (1 << 64) if value >> 63 else value
        place = value & ((1 << BITS) - 1)
        self[word] = signed = signed if self.frequent[place >> 3] >> (place & 7) & 1 else 0
        return signed


def lead(words: list, rotl) -> object:
    """A key of leading words: ids, each rotated by its place, joined by xor."""
    key = words[0]
    for at, w in enumerate(words[1:], 1):
        key = key ^ rotl(w, 11 * at)
    return key


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def leads(columns: list[np.ndarray], depth: int) -> np.ndarray:
    return lead([c.view(np.uint64) for c in columns[:depth]], _rotate)


class _Xor:
    """``lead`` over columns."""

    def __init__(self, c: Column):
        self.c = c

    def __xor__(self, other: _Xor) -> _Xor:
        return _Xor(self.c.bitwiseXOR(other.c))


def lead_column(names: list[str]) -> Column:
    def rotl(x: _Xor, by: int) -> _Xor:
        return _Xor(F.shiftleft(x.c, by).bitwiseOR(F.shiftrightunsigned(x.c, 64 - by)))
    return lead([_Xor(F.col(c)) for c in names], rotl).c


def bitmap(keys: DataFrame, key: Column) -> np.ndarray:
    """A bitmap of ``2**BITS`` places with those of the keys set; its blocks
    (of fixed number and size) meet on the driver."""
    rows = (keys.select((key.bitwiseAND(F.lit((1 << BITS) - 1)) + 1).alias("place"))   # buckets begin at place 1
            .groupBy(F.expr("bitmap_bucket_number(place)").alias("block"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")).collect())
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for r in rows:
        bits = np.frombuffer(r["bits"], np.uint8)
        out[(r["block"] - 1) * len(bits):r["block"] * len(bits)] = bits
    return out


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def collapse(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal suffixes as one, counts added."""
    if not len(n):
        return columns, n
    mixed = leads(columns, DEPTH)
    order = np.argsort(mixed, kind="stable")
    columns = [c[order] for c in columns]
    new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.add.reduceat(n[order], starts)


def _batch(columns: list[np.ndarray], n: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n, pa.int64()), *map(pa.array, more.values())],
                                      names=[*SUFFIX, "n", *more])


def _suffixes(seed: str, mask: int, frequent):
    """mapInArrow function: texts to collapsed suffixes."""
    def shifted(ids: np.ndarray, count: int) -> pa.RecordBatch:
        """Suffixes from the first ``count`` places."""
        wide = np.concatenate([ids, np.zeros(DEPTH, np.int64)])
        columns = [wide[k:k + count].copy() for k in range(DEPTH)]
        for before, after in pairwise(columns):
            after[before == 0] = 0
        two = columns[1] != 0
        return _batch(*collapse([c[two] for c in columns], np.ones(int(two.sum()), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Ids] = {}
        held: list[np.ndarray] = []
        size = 0
        for lang, text in _texts(batches):
            if lang not in known:
                if len(known) >= 16:
                    known.clear()
                known[lang] = Ids(lang, seed, mask, frequent.value)
            get = known[lang].__getitem__
            for words in word_lists(text):
                ids = np.fromiter(map(get, words), np.int64, len(words))
                held.append(ids[ids != -1])
                size += len(held[-1])
                if size >= BUFFER + DEPTH:
                    every = np.concatenate(held)
                    yield shifted(every, size - DEPTH + 1)
                    held = [every[size - DEPTH + 1:]]
                    size = DEPTH - 1
            held.append(np.zeros(1, np.int64))
            size += 1
        if held:
            every = np.concatenate(held)
            yield shifted(every, len(every))
    return run


class Vocabulary:
    """Word counts: ``words`` has ``(lang, id, word, n)`` of the frequent,
    ``totals`` ``(lang, n)`` of all."""

    def __init__(self, docs: DataFrame, least: int, id_bits: int = 64, seeds: int = 8):
        """``docs``: ``(lang, text)``.  ``id_bits``: of the hash that is used,
        fewer only in tests."""
        counted = materialize(docs.mapInArrow(_count, COUNT_SCHEMA).groupBy("lang", "word")
                              .agg(F.sum("n").alias("n")), "words")
        self.totals = materialize(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        self.mask = (1 << id_bits) - 1 if id_bits < 64 else -1
        for seed in map(str, range(seeds)):
            named = counted.withColumn("id", word_id(F.lit(seed), self.mask))
            if not named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect():
                break
        else:
            raise ValueError("no seed gives every word an id of its own")
        self.seed = seed
        self.words = materialize(named.filter(F.col("n") >= least).select("lang", "id", "word", "n"), "vocabulary")


def suffixes(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(w1..w5, n)``: suffixes of two or more frequent words, stored."""
    frequent = docs.sparkSession.sparkContext.broadcast(bitmap(vocabulary.words, F.col("id")))
    mask = vocabulary.mask if vocabulary.mask >= 0 else (1 << 64) - 1
    return materialize(docs.mapInArrow(_suffixes(vocabulary.seed, mask, frequent), SUFFIX_SCHEMA), "suffixes")


def _cut(columns: list[np.ndarray], n: np.ndarray, bits: dict, deepest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Suffixes of three or more words cut at the first pair of neighbours that
    is not frequent (pairs themselves have been counted).

    ``bits``: for each number of leading words the bitmaps of frequent and
    crowded keys."""
    kept = has(bits[2][0], leads(columns, 2))
    columns, n = [c[kept] for c in columns], n[kept]
    # a phrase is at most as frequent as each pair of neighbours in it
    for at in range(1, DEPTH - 1):
        pair = has(bits[2][0], leads(columns[at:], 2))
        columns[at + 1] = np.where(pair & (columns[at] != 0), columns[at + 1], 0)
    # below crowded leading words, longer ones have been counted too
    crowded = np.ones(len(n), bool)
    for d in range(2, deepest):
        crowded &= has(bits[d][1], leads(columns, d))
        rare = crowded & ~has(bits[d + 1][0], leads(columns, d + 1))
        for c in columns[d:]:
            c[rare] = 0
    longer = columns[2] != 0
    return [c[longer] for c in columns], n[longer]


def _suffix_columns(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    return [batch.column(c).to_numpy() for c in SUFFIX if c in batch.schema.names], batch.column("n").to_numpy()


def _sketch(depths: list[int], bits: int, least: int, levels: dict, deepest: int):
    """mapInArrow function: suffixes to the counts of their leading words'
    places, none above ``least``; compressed, as most are zero.  With
    ``levels`` (see ``_cut``) the suffixes are cut first."""
    kind = np.min_scalar_type(2 * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {d: (f.value, c.value) for d, (f, c) in levels.items()}
        held: dict[int, list[tuple]] = defaultdict(list)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for depth, parts in held.items():
                place = np.concatenate([p for p, _ in parts])
                n = np.concatenate([c for _, c in parts])
                order = np.argsort(place)
                place, n = place[order], n[order]
                starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                place, n = place[starts], np.minimum(np.add.reduceat(n, starts), least)
                block = place >> np.uint32(BLOCK)
                first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                packed = []
                for low, high in zip(first, np.r_[first[1:], len(place)]):
                    dense = np.zeros(1 << BLOCK, kind)
                    dense[place[low:high] & np.uint32((1 << BLOCK) - 1)] = n[low:high]
                    packed.append(zlib.compress(dense, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), depth, np.int32)), pa.array(block[first].astype(np.int32)),
                     pa.array(packed, pa.binary())], names=["depth", "block", "places"])
            held.clear()

        for batch in batches:
            columns, n = _suffix_columns(batch)
            if known:
                columns, n = _cut(columns, n, known, deepest)
            for depth in depths:
                whole = columns[depth - 1] != 0
                if whole.any():
                    key = leads([c[whole] for c in columns], depth) & np.uint64((1 << bits) - 1)
                    held[depth].append((key.astype(np.uint32), n[whole]))
            size += len(n)
            if size >= SKETCH_ROWS:
                yield from out()
                size = 0
        yield from out()
    return run


def _reached(least: int):
    """mapInArrow function: the parts of each block added up, to a bit a place."""
    kind = np.min_scalar_type(2 * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for depth, block, places in zip(*(batch.column(c).to_pylist() for c in ("depth", "block", "places"))):
                some = np.frombuffer(zlib.decompress(places), kind)
                before = sums.get((depth, block))
                sums[depth, block] = some if before is None else np.minimum(before + some, least).astype(kind)
        for (depth, block), n in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([depth], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([np.packbits(n >= least, bitorder="little").tobytes()], pa.binary())],
                names=["depth", "block", "places"])
    return run


def sketch(some: DataFrame, depths: list[int], bits: int, least: int, levels: dict | None = None,
           deepest: int = 2) -> dict:
    """For each number of leading words a bitmap, sent to the tasks, of the
    ``2**bits`` places where suffixes that weigh ``least`` or more in all meet:
    every frequent key is on one, few others are.  The counts are added up in
    blocks; their bits, of bounded size, meet on the driver."""
    spark = some.sparkSession
    counts = some.mapInArrow(_sketch(depths, bits, least, levels or {}, deepest), BLOCK_SCHEMA)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.repartition(parts, "depth", "block").mapInArrow(_reached(least), BLOCK_SCHEMA).collect()
    out = {d: np.zeros(1 << bits >> 3, np.uint8) for d in depths}
    for r in rows:
        at = r["block"] << BLOCK >> 3
        out[r["depth"]][at:at + len(r["places"])] = np.frombuffer(r["places"], np.uint8)
    return {d: spark.sparkContext.broadcast(b) for d, b in out.items()}


def _routing(levels: dict, deepest: int, reached: dict):
    """mapInArrow function: suffixes to the surviving ones with their key, cut
    as by ``_cut`` and at the first leading words that the bitmaps ``reached``
    lack.."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {d: (f.value, c.value) for d, (f, c) in levels.items()}
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate([h[k] for h in held]) for k in range(DEPTH)]
            columns, n = collapse(columns, np.concatenate([h[DEPTH] for h in held]))
            key, crowded = leads(columns, 2), np.ones(len(n), bool)
            level = np.full(len(n), 2, np.int32)
            for d in range(2, deepest):
                crowded &= has(bits[d][1], leads(columns, d))
                key = np.where(crowded, leads(columns, d + 1), key)
                level += crowded
            return _batch(columns, n, key=key.view(np.int64), level=level)

        for batch in batches:
            columns, n = _cut(*_suffix_columns(batch), bits, deepest)
            for d, places in reached.items():
                rare = ~has(places.value, leads(columns, d))
                for c in columns[d - 1:]:
                    c[rare] = 0
            longer = columns[2] != 0
            held.append((*[c[longer] for c in columns], n[longer]))
            size += int(longer.sum())
            if size >= BUFFER:
                yield out()
                held, size = [], 0
        if held:
            yield out()
    return run


def quicksort(columns: list[np.ndarray], n: np.ndarray, least: int) -> tuple[list[int], list[int], list[int]]:
    """Multikey three-way quicksort of pointers to suffixes: ``(one suffix,
    length, count)`` of every phrase that weighs ``least`` or more.  Parts that
    weigh less are abandoned."""
    at, length, count = [], [], []
    stack = [(np.arange(len(n)), 0)]
    while stack:
        ptr, depth = stack.pop()
        while len(ptr) and n[ptr].sum() >= least:
            word = columns[depth][ptr]
            pivot = np.sort(word[[0, len(word) // 2, -1]])[1] if len(word) < 64 else np.sort(word[::len(word) // 32])[16]
            same = ptr[word == pivot]
            weight = int(n[same].sum())
            if pivot and weight >= least:
                at.append(int(same[0]))
                length.append(depth + 1)
                count.append(weight)
                if depth + 1 < len(columns):
                    stack.append((same, depth + 1))
            stack.append((ptr[word < pivot], depth))
            ptr = ptr[word > pivot]
    return at, length, count


def _sort(least: int):
    """mapInArrow function: the suffixes of a partition to its phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        columns = [whole[c].to_numpy() for c in SUFFIX]
        at, length, count = (np.array(x, np.int64) for x in quicksort(columns, whole["n"].to_numpy(), least))
        # leading words shorter than the routing key may be elsewhere too
        mine = length >= np.maximum(whole["level"].to_numpy()[at], 3)
        at, length, count = at[mine], length[mine], count[mine]
        yield _batch([np.where(k < length, columns[k][at], 0) for k in range(DEPTH)], count)
    return run


def frequent(stored: DataFrame, least: int = LEAST, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``(w1..w5, n)``: all phrases of two or more words that occur ``least``
    times or more, from stored ``suffixes``."""
    spark = stored.sparkSession
    size = stored.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    # few large tasks count the leading words, so that most counts meet before the shuffle
    few = below = stored.coalesce(max(-(-size["rows"] // COUNT_ROWS), 1))
    low, high = SKETCH_BITS
    bits = min(max(((size["n"] or 0) // SKETCH_LOAD).bit_length(), low), high)
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max((size["n"] or 0) // max(least_parts, -(-size["rows"] // partition_rows)) // 2, least)
    levels, counted = {}, []
    for depth in range(2, DEPTH + 1):
        names = SUFFIX[:depth]
        # only the leading words are read and sent to Python
        leading = below.filter(F.col(names[-1]) != 0).select(*names, "n")
        likely = sketch(leading, [depth], bits, least)[depth]
        found = (leading.mapInArrow(_below(likely, depth), leading.schema).groupBy(*names).agg(F.sum("n").alias("n"))
                 .filter(F.col("n") >= least))
        found = materialize(found, "leading")
        busy = bitmap(found.filter(F.col("n") > limit), lead_column(names))
        sent = spark.sparkContext.broadcast(busy)
        levels[depth] = (spark.sparkContext.broadcast(bitmap(found, lead_column(names))), sent)
        # all pairs are counted here; of longer leads what the bitmap calls crowded
        full = found.select(*names, *[F.lit(0).cast("long").alias(c) for c in SUFFIX[depth:]], "n")
        counted.append(full if depth == 2 else full.mapInArrow(_below(sent, depth), SUFFIX_SCHEMA))
        if not busy.any() or depth == DEPTH:
            break
        below = below.mapInArrow(_below(sent, depth), SUFFIX_SCHEMA)
    if depth > 2:
        counted.pop()      # of the last lead all go to the sort
    longer = few.filter(F.col(SUFFIX[2]) != 0)      # pairs are counted
    reached = sketch(longer, list(range(3, DEPTH + 1)), bits, least, levels, depth)
    routed = materialize(longer.mapInArrow(_routing(levels, depth, reached), SUFFIX_SCHEMA + ", key long, level int"), "routed")
    parts = max(least_parts, -(-routed.count() // partition_rows))
    phrases = routed.repartition(parts, "key").mapInArrow(_sort(least), SUFFIX_SCHEMA)
    for some in counted:
        phrases = phrases.unionByName(some)
    return materialize(phrases, "phrases")


def _below(busy, depth: int):
    """mapInArrow function: the rows whose ``depth`` leading words the bitmap has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(busy.value, leads(_suffix_columns(batch)[0], depth))))
    return run


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, text_col: str = "text",
                 lang_col: str = "lang", partition_rows: int = PARTITION_ROWS, id_bits: int = 64) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each
    language, scored by their weakest cut."""
    spoken = _spoken(docs, text_col, lang_col)
    vocabulary = Vocabulary(spoken, least, id_bits)
    found = frequent(suffixes(spoken, vocabulary), least, partition_rows)
    ids = F.filter(F.array(*SUFFIX), lambda x: x != 0)
    several = materialize(found.select(ids.alias("p"), F.col("n").alias("a")), "candidates")
    counts = several.unionByName(vocabulary.words.select(F.array("id").alias("p"), F.col("n").alias("a")))
    parts = (several.filter(F.size("p") > 2)
             .withColumn("size", F.explode(F.sequence(F.lit(2), F.size("p") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("p") - F.col("size") + 1)))
             .groupBy(F.slice("p", F.col("at"), F.col("size")).alias("part")).agg(F.max("a").alias("longer")))
    kept = (several.join(parts, several["p"] == parts["part"], "left")
            .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).select("p", "a"))
    kept = materialize(kept, "kept")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    known = maybe_broadcast(counts)
    left = known.select(F.col("p").alias("first"), F.col("a").alias("l"))
    right = known.select(F.col("p").alias("rest"), F.col("a").alias("r"))
    cuts = (cuts.withColumn("first", F.slice("p", 1, F.col("k")))
            .withColumn("rest", F.slice("p", F.col("k") + 1, F.size("p"))).join(left, "first").join(right, "rest"))
    named = maybe_broadcast(vocabulary.words.select("id", "lang", "word"))
    spelt = (kept.select("p", F.posexplode("p").alias("at", "id")).join(named, "id")
             .groupBy("p").agg(F.min("lang").alias("lang"),
                               F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ")
                               .alias("phrase")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(spelt, "p").join(maybe_broadcast(vocabulary.totals), "lang")
    cuts = cuts.withColumn("above", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(19,0)") * wide("n"))
    cuts = cuts.withColumn("below", wide("l") * wide("r")).withColumn("score", F.expr("above div below"))
    weakest = cuts.groupBy("p", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = weakest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                            F.col("cut.score").alias("score")).withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # the best of 64 parts of a language first, so that no task ranks a whole language
    some = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang", "deal").orderBy(*order)))
    best = some.filter(F.col("rank") <= top).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for the query: all phrases counted one by one."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}',
                '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM words),
runs AS (SELECT lang, w, pos, unnest(range(1, least({DEPTH}, len(w) - pos + 1) + 1)) AS size FROM spans),
counted AS (
  SELECT lang, array_to_string(w[pos:pos + size - 1], ' ') AS phrase, size, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE size = 1 GROUP BY lang),
candidate AS (SELECT lang, phrase, string_split(phrase, ' ') AS p, size, f AS a FROM counted
              WHERE size > 1 AND f >= {LEAST}),
inner_parts AS (
  SELECT DISTINCT lang, array_to_string(p[pos:pos + part - 1], ' ') AS phrase, a AS longer
  FROM (SELECT lang, p, size, a, part, unnest(range(1, size - part + 2)) AS pos
        FROM (SELECT *, unnest(range(2, size)) AS part FROM candidate))),
kept AS (
  SELECT * FROM candidate c WHERE NOT EXISTS (
    SELECT 1 FROM inner_parts i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.longer >= {SHARE} * c.a)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(p[1:k], ' ') AS first, array_to_string(p[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n,
         (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.first
  JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {TOP}"""
