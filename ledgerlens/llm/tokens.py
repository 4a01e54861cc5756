"""Token-ID / binary output: documents as Simple-8b coded shard files.

``write_token_files`` range-partitions the documents by id (one shuffle of the
texts), tokenizes them inside the tasks and writes Parquet files of shard
rows.  A shard holds whole documents in ascending id order, about
``SHARD_IDS`` ids of them (a longer document is a shard of its own):

    part, seq        place of the shard: range partition, running number
    n_ids            ids in the shard
    doc_ids, n_tokens  its documents: id (null for a null id) and ids of each
    ids              the ids of all its documents as ``simple8b.pack`` bytes

Spark's own writer commits the files, so a repeated or lost task leaves no
half shard, and any store that Spark can write to will do.

``read_token_files`` decodes them: one row per document with its place in the
whole stream.  ``read_range`` opens only the blocks that a slice needs.

Defined results: a null text is an empty text and gives just the end id; a
null id comes first; documents of one id are all kept, in the order of their
text's hash and then of their place in the input; an empty table gives no
shard and no row; further columns of the input are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm import simple8b
from ledgerlens.llm.common import scratch_path, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SHARD_IDS = 1 << 19
# Texts tokenized at once, and chunks whose ids a worker remembers.
BATCH_BYTES = 2 << 20
CACHE_CHUNKS = 500_000
JOINED = 32  # new chunks that are encoded in one call

SHARD_SCHEMA = "part int, seq int, n_ids long, doc_ids array<long>, n_tokens array<long>, ids binary"
DOC_SCHEMA = "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, twice as long as often as ``n`` entries need it."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
    out[:len(a)] = a
    return out


class ChunkEncoder:
    """Ids of texts under a byte-level BPE.

    The pre-tokenizer of such a vocabulary always starts a new piece at a
    space between two non-space characters, so a text may be cut there and the
    chunks encoded apart; repeated chunks are encoded once.  A text where a
    space meets other white space is encoded whole.

    Known chunks have a slot: a stretch of ``pool``.  When there are
    ``CACHE_CHUNKS`` of them, the half that was met in fewer slices is
    forgotten, which bounds the memory and keeps what is frequent."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()  # a byte-level token has a character for each byte
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        self.after_space: dict[str, int] = {}
        self.leading: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        # of each slot: first place in the pool, length, slices that met it
        self.begin, self.size, self.met = (np.zeros(1 << 14, dtype=np.int64) for _ in range(3))
        self.slots = self.pooled = 0

    def _forget(self) -> None:
        """Keep the ``CACHE_CHUNKS // 2`` slots met most often, the later of a
        tie; their counts are halved, so that what was frequent once ages."""
        often = np.argsort(self.met[:self.slots], kind="stable")[-(CACHE_CHUNKS // 2):]
        keep = np.sort(often)
        place = np.full(self.slots, -1, dtype=np.int64)
        place[keep] = np.arange(len(keep))
        moved = place.tolist()
        for name in ("after_space", "leading"):
            known = getattr(self, name)
            setattr(self, name, {w: moved[i] for w, i in known.items() if moved[i] >= 0})
        pool, size, met = self._ids(keep), self.size[keep], self.met[keep] // 2
        self.slots = self.pooled = 0
        self._add(pool, size)
        self.met[:self.slots] = met

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that follow a space each, and the number of each: many
        words are encoded as one text and told apart by their bytes."""
        runs = self._plain([" " + " ".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)])
        ids = np.fromiter(chain.from_iterable(runs), dtype=np.int64, count=sum(map(len, runs)))
        at = np.cumsum(self.token_bytes[ids])
        ends = np.cumsum(1 + pc.binary_length(pa.array(words, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.searchsorted(at, ends)
        if len(words) and not (cuts[-1] < len(at) and (at[cuts] == ends).all()):
            raise ValueError("a token runs over a space: not a byte-level vocabulary")
        return ids.astype(np.uint32), np.diff(cuts, prepend=-1)

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._plain(words)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum())), size

    def _add(self, fresh: np.ndarray, size: np.ndarray) -> range:
        """Slots of new chunks."""
        first, at = self.slots, self.pooled
        self.slots, self.pooled = first + len(size), at + len(fresh)
        self.pool = _room(self.pool, self.pooled)
        self.begin, self.size, self.met = (_room(a, self.slots) for a in (self.begin, self.size, self.met))
        self.pool[at:self.pooled] = fresh
        self.begin[first:self.slots] = at + np.cumsum(size) - size
        self.size[first:self.slots] = size
        self.met[first:self.slots] = 0
        return range(first, self.slots)

    def _slots(self, known: dict[str, int], words: list[str], encode) -> np.ndarray:
        """The slot of each word; -1 for one that may not stand alone."""
        got = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        miss = [i for i in np.flatnonzero(got < 0).tolist()
                if words[i] and not (words[i][0].isspace() or words[i][-1].isspace())]
        new = [words[i] for i in miss]
        slots = self._add(*encode(new))
        got[miss] = slots
        known.update(zip(new, slots))
        self.met[got[got >= 0]] += 1
        return got

    def _ids(self, slots: np.ndarray) -> np.ndarray:
        """The ids in the slots, in a row."""
        size = self.size[slots]
        last = np.cumsum(size)
        return self.pool[np.repeat(self.begin[slots] - (last - size), size) + np.arange(last[-1] if len(last) else 0)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts in a row, each with the end id, number of ids of
        each)``."""
        n = len(texts)
        if self.slots > CACHE_CHUNKS:
            self._forget()
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        first = offsets[:-1]
        lead, which = np.unique(index[first], return_inverse=True)
        slots = self._slots(self.after_space, words, self._joined)[index]
        slots[first] = self._slots(self.leading, [words[i] for i in lead.tolist()], self._apart)[which]
        whole = np.flatnonzero(np.minimum.reduceat(slots, first) < 0) if n else []
        end = self._add(np.array([end_id], dtype=np.uint32), np.ones(1, dtype=np.int64))[0]
        slots = np.insert(np.maximum(slots, 0), offsets[1:], end)
        ids = self._ids(slots)
        counts = np.add.reduceat(self.size[slots], first + np.arange(n)) if n else np.zeros(0, np.int64)
        if len(whole):
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for i, v in zip(whole, self._plain([texts[int(i)].as_py() for i in whole])):
                pieces[i] = np.array([*v, end_id], dtype=np.uint32)
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)
        return ids, counts


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of ``column``."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        before = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def shard_writer(path: str, end_id: int):
    """mapInArrow function: sorted documents of one partition to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, counts, streams, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(streams)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "n_tokens": pa.array([counts], pa.list_(pa.int64())),
                "ids": pa.array([simple8b.pack(ids)], pa.binary())})

        for batch in batches:
            for rows in _slices(batch, "text", BATCH_BYTES):
                texts = rows.column("text")
                ids, n = encoder.encode(pc.fill_null(texts, "").cast(pa.string()), end_id)
                begin = 0
                for doc, end in zip(rows.column("doc_id").to_pylist(), np.cumsum(n).tolist()):
                    if held and held + end - begin > SHARD_IDS:
                        yield shard()
                        seq += 1
                        doc_ids, counts, streams, held = [], [], [], 0
                    doc_ids.append(doc)
                    counts.append(end - begin)
                    streams.append(ids[begin:end])
                    held += end - begin
                    begin = end
        if doc_ids:
            yield shard()

    return run


def write_token_files(docs: DataFrame, out: str, vocabulary: str, end_id: int = END_ID,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents' ids as shard files under ``out``."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows of one id are told apart by their text and their place, so that a
    # very frequent id is cut into ranges like any other stretch of rows.
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc(), F.col("row").asc()]
    ranged = (keyed.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    (ranged.mapInArrow(shard_writer(vocabulary, end_id), SHARD_SCHEMA)
     .write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(out))


def shard_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: shards to one row per document."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i] for k in ("part", "seq", "doc_ids", "n_tokens", "ids")}
            ids = simple8b.unpack(row["ids"].as_buffer()).astype("<u4")
            n = np.array(row["n_tokens"].as_py(), dtype=np.int64)
            end = np.cumsum(n)
            view = memoryview(ids)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(n), row["part"].as_py()), pa.int32()),
                "seq": pa.array(np.full(len(n), row["seq"].as_py()), pa.int32()),
                "doc_id": pa.array(row["doc_ids"].as_py(), pa.int64()),
                "before": pa.array(end - n, pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in zip((end - n).tolist(), end.tolist())],
                                      pa.int64())})


def shard_places(spark: SparkSession, path: str) -> DataFrame:
    """``(part, seq, base)``: ids before each shard.  Only the narrow columns
    are read; the one unpartitioned window runs over a row per partition."""
    shards = spark.read.parquet(path).select("part", "seq", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_base"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return (shards.withColumn("own", inside).join(before, "part")
            .select("part", "seq", (F.col("part_base") + F.col("own")).alias("base")))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32``."""
    docs = (spark.read.parquet(path).select("part", "seq", "doc_ids", "n_tokens", "ids")
            .mapInArrow(shard_reader, DOC_SCHEMA))
    return (docs.join(shard_places(spark, path), ["part", "seq"])
            .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """``(position, id)`` of the ids from ``start`` to ``stop`` (exclusive) of
    the whole stream.  Only shards that meet the range are read and only their
    blocks in it decoded."""
    hit = (shard_places(spark, path).join(spark.read.parquet(path).select("part", "seq", "n_ids", "ids"),
                                          ["part", "seq"])
           .filter((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start)).select("base", "n_ids", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, n = batch.column("base")[i].as_py(), batch.column("n_ids")[i].as_py()
                lo, hi = max(start - base, 0), min(stop - base, n)
                first = lo // simple8b.BLOCK
                ids = simple8b.unpack(batch.column("ids")[i].as_buffer(), first, -(-hi // simple8b.BLOCK))
                ids = ids[lo - first * simple8b.BLOCK:hi - first * simple8b.BLOCK]
                yield pa.RecordBatch.from_pydict({"position": pa.array(np.arange(base + lo, base + hi), pa.int64()),
                                                  "id": pa.array(ids.astype(np.int64), pa.int64())})

    return hit.mapInArrow(run, "position long, id long")


def token_output(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    out = scratch_path(spark, "tokens")
    write_token_files(docs, out, tokenizer_path())
    return read_token_files(spark, out)


def op4_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, table(spark, sf_dir, "documents"))
