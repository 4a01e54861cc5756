"""Hard-negative mining by angular triangle filtering.

A row's vector is scaled to integers; its score for an anchor is their integer
inner product.  Let a(q, v) be the angle between two vectors and r a reference
direction.  By the triangle inequality on the sphere

    |a(q, r) - a(r, v)| <= a(q, v) <= min(a(q, r) + a(r, v), 2 pi - a(q, r) - a(r, v)),

so stored angles to the references give an interval of the cosine, and this
times both lengths one of the score.  Rounding is covered by ``SLACK`` on the
angle and by one unit, and a relative slack, on the score: a bound never cuts
off a true score.

1. ``references``: directions chosen by farthest-first traversal of a bounded
   sample (``FIT_ROWS`` rows of smallest hash).  They decide how tight the
   bounds are, never what is found.
2. ``blocks``: every row, with its length and its angles to all references,
   range-partitioned by (nearest reference, angle to it, id) and written to the
   shared folder in blocks of ``BLOCK`` rows.  ``WINDOW`` neighbours of a block
   share an interval of angles to each reference and one of lengths.
3. Anchors (the stated query set) are packed in slices of ``SLICE`` and meet
   all blocks, block by block, by an equi-join on the slice's number.  For an
   anchor, a window whose score bounds do not reach the scores still wanted is
   passed over; the rest get the integer product.  A sample row of the right
   kind bounds the wanted scores from the start.
4. Each (anchor, block) returns its best few rows; the best of all blocks are
   taken by window functions.

``positives`` asks for the best rows of the anchor's label, ``negatives`` for
the best rows of another label within a share of a positive's score.

Defined results: a row with a null id, null label, null vector or any null or
non-finite component takes no part; an empty vector scores 0 with all; a
shorter vector counts as padded with zeros; repeated rows stand for themselves
(tied rows of one id are interchangeable), but a repeated anchor is one anchor,
and no row of an anchor's id is a positive or a negative of it; anchors of one
id with different vectors or labels are mined apart; an anchor without
positives returns nothing; scores beyond 64 bits are an error.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, maybe_broadcast, table

SCALE = 256
REFERENCES = 16
FIT_ROWS = 2048
BLOCK = 1024
WINDOW = 64
SLICE = 512
POSITIVES = 5
NEGATIVES = 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
# Radians; angles are stored as 32-bit floats, whose error is below 5e-7.
SLACK = 2e-6
ROW_SCHEMA = "near int, angle double, id long, label int, hash long, size double, v binary, angles binary"
PACK_SCHEMA = "ids binary, labels binary, hashes binary, sizes binary, v binary, angles binary"
FOUND_SCHEMA = "anchor_id long, anchor_hash long, nth int, score long, id long"


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
             scale: int = SCALE) -> DataFrame:
    """``(id, label, v, hash)``: the rows that take part, vectors scaled to
    whole numbers (held as doubles), ``hash`` one of label and vector."""
    label = F.col("label") if label is None else label
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull()).filter(~bad)
    scaled = F.transform(vector_col, lambda x: F.rint(F.floor(x.cast("double") * scale)))
    out = kept.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("label"), scaled.alias("v"))
    return out.withColumn("hash", F.xxhash64("label", "v"))


def references(rows: DataFrame, k: int = REFERENCES, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, dict]:
    """``(k directions, sample)``: unit vectors as rows, chosen one by one as
    the sample row farthest in angle from those before.  The sample's ids,
    labels and vectors come along."""
    dims = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    found = rows.orderBy(F.xxhash64("id", "hash"), "id", "hash").limit(fit_rows).collect()
    v = np.zeros((len(found), dims))
    for at, r in enumerate(found):
        v[at, :len(r["v"])] = r["v"]
    sample = {"ids": np.array([r["id"] for r in found], np.int64),
              "labels": np.array([r["label"] for r in found], np.int32), "v": v}
    size = np.sqrt((v * v).sum(1))
    unit = v[size > 0] / size[size > 0, None]
    chosen = np.zeros((0, dims))
    closest = np.full(len(unit), -np.inf)
    while len(chosen) < k and len(unit) and closest.min() < 1 - 1e-9:
        chosen = np.vstack([chosen, unit[closest.argmin()]])
        closest = np.maximum(closest, unit @ chosen[-1])
    return chosen, sample


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as rows, padded with zeros."""
    lists = batch.column("v")
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((batch.num_rows, dims))
    out[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def located(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """Every row with its length and its angles to the references."""
    sent = rows.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = sent.value
        for batch in batches:
            v = _rows(batch, refs.shape[1])
            size = np.sqrt((v * v).sum(1))
            cos = (v @ refs.T) / np.where(size > 0, size, 1)[:, None]
            angles = np.arccos(np.clip(cos, -1, 1)).astype(np.float32)
            near = angles.argmin(1) if len(refs) else np.zeros(len(v), int)
            angle = angles[np.arange(len(v)), near] if len(refs) else np.zeros(len(v))
            if len(v) and np.abs(v).max(initial=0) >= 2 ** 62:
                raise OverflowError("a scaled component is beyond 64 bits")
            yield pa.RecordBatch.from_arrays(
                [pa.array(near, pa.int32()), pa.array(angle, pa.float64()), batch.column("id"), batch.column("label"),
                 batch.column("hash"), pa.array(size), pa.array([x.tobytes() for x in v.astype(_kind(v))], pa.binary()),
                 pa.array([x.tobytes() for x in angles], pa.binary())],
                names=["near", "angle", "id", "label", "hash", "size", "v", "angles"])

    return rows.mapInArrow(run, ROW_SCHEMA)


def _kind(v: np.ndarray) -> np.dtype:
    """Four bytes a component where the batch's values fit, else eight; told
    apart again by the payload's length."""
    return np.dtype("<i4") if np.abs(v).max(initial=0) < 2 ** 31 else np.dtype("<f8")


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * n else "<f8").astype(np.float64)


def _unpack_v(raw: list[bytes], dims: int) -> np.ndarray:
    return np.array([_numbers(x, dims) for x in raw]).reshape(len(raw), dims)


def _packer(size: int, dims: int):
    """mapInArrow function: rows in the order they come, in packs of ``size``."""
    def pack(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(part)
        v = _unpack_v(t["v"].to_pylist(), dims)
        number = {c: t[c].to_numpy() for c in ("id", "label", "hash", "size")}
        data = [number["id"].astype("<i8"), number["label"].astype("<i4"), number["hash"].astype("<i8"),
                number["size"].astype("<f8"), v.astype(_kind(v))]
        more = {c: [b"".join(t[c].to_pylist())] for c in t.column_names if c in ("angles", "wanted")}
        names = ["ids", "labels", "hashes", "sizes", "v"]
        return pa.RecordBatch.from_pydict(dict(zip(names, ([x.tobytes()] for x in data))) | more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        have = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - have)
                waiting.append(part)
                at, have = at + part.num_rows, have + part.num_rows
                if have == size:
                    yield pack(waiting)
                    waiting, have = [], 0
        if waiting:
            yield pack(waiting)
    return run


def blocks(rows: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """All rows (from ``located``) in stored blocks of neighbours in angle."""
    order = ["near", "angle", "id", "hash"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(_packer(size, dims), PACK_SCHEMA), "angle-blocks")


def slices(anchors: DataFrame, dims: int, size: int = SLICE) -> DataFrame:
    """Anchors in stored, numbered slices.  ``wanted`` holds what is asked for
    (see ``_search``), as 64-bit numbers."""
    packed = materialize(anchors.mapInArrow(_packer(size, dims), PACK_SCHEMA + ", wanted binary")
                         .withColumn("__uid", F.monotonically_increasing_id()), "anchor-slices")
    # numbers only: a row a slice
    number = packed.select("__uid").withColumn("slice", F.row_number().over(W.orderBy("__uid")) - 1)
    return packed.join(maybe_broadcast(number), "__uid").drop("__uid")


class Pack:
    """A block of rows or a slice of anchors, unpacked."""

    def __init__(self, row: dict, prefix: str, refs: int, dims: int):
        get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.ids, self.labels, self.hashes = get("ids", "<i8"), get("labels", "<i4"), get("hashes", "<i8")
        self.sizes = get("sizes", "<f8")
        n = len(self.ids)
        self.v = _numbers(row[prefix + "v"], n * dims).reshape(n, dims)
        self.angles = get("angles", "<f4").reshape(n, refs).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of whole numbers held as doubles, exact: by
    doubles where every partial sum is below 2**53, else by long integers."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    out = (np.vectorize(int, otypes=[object])(a)) @ (np.vectorize(int, otypes=[object])(b)).T
    if max(map(abs, out.ravel()), default=0) >= 2 ** 63:
        raise OverflowError("a score is beyond 64 bits")
    return out.astype(np.int64)


def bounds(q: Pack, rows: Pack, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score that an anchor (row) can have with any row of
    a window (column)."""
    starts = np.arange(0, len(rows.ids), window)
    least, most = np.minimum.reduceat(rows.angles, starts), np.maximum.reduceat(rows.angles, starts)
    short, long = np.minimum.reduceat(rows.sizes, starts), np.maximum.reduceat(rows.sizes, starts)
    low, high = np.zeros((len(q.ids), len(starts))), np.full((len(q.ids), len(starts)), np.pi)
    for k in range(q.angles.shape[1]):
        a = q.angles[:, k, None]
        low = np.maximum(low, np.maximum(a - most[:, k], least[:, k] - a))
        high = np.minimum(high, np.minimum(a + most[:, k], 2 * np.pi - a - least[:, k]))
    top, bottom = np.cos(np.maximum(low - SLACK, 0)), np.cos(np.minimum(high + SLACK, np.pi))
    unit = q.sizes[:, None]
    above = top * unit * np.where(top >= 0, long, short)
    below = bottom * unit * np.where(bottom >= 0, short, long)
    slack = 1 + 1e-9 * unit * long
    return below - slack, above + slack


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each group: highest score, then lowest id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    return order[rank < k]


def _search(refs: int, dims: int, window: int, k: int, same: bool):
    """mapInArrow function over pairs of a slice (``q_``) and a block.

    An anchor's ``wanted`` is a row of numbers.  Same label: the score that a
    row must reach.  Other label: ``POSITIVES`` pairs of least and greatest
    score, each a question (``nth``) of its own; least over greatest is none.
    The last scores found raise what must be reached."""
    def one(q: Pack, rows: Pack, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        below, above = bounds(q, rows, window)
        least, most = wanted[:, 0::2], (wanted[:, 1::2] if not same else np.full((len(wanted), 1), 2 ** 63 - 1))
        asked = least.shape[1]
        least = least.copy()
        held = [np.zeros(0, np.int64) for _ in range(3)]   # question, score, row
        for w in np.argsort(-above.max(axis=0, initial=0), kind="stable"):
            hit = ((above[:, w, None] >= least) & (below[:, w, None] <= most) & (least <= most)).any(1)
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            here = np.arange(w * window, min((w + 1) * window, len(rows.ids)))
            score = products(q.v[at], rows.v[here])
            alike = (q.labels[at, None] == rows.labels[here]) == same
            alike &= q.ids[at, None] != rows.ids[here]
            for nth in range(asked):
                a, r = np.nonzero(alike & (score >= least[at, nth, None]) & (score <= most[at, nth, None]))
                if not len(a):
                    continue
                new = (at[a] * asked + nth, score[a, r], here[r])
                held = [np.concatenate(x) for x in zip(held, new)]
                keep = best(held[0], held[1], rows.ids[held[2]], k)
                held = [x[keep] for x in held]
                question, counts = np.unique(held[0], return_counts=True)
                full = question[counts == k]
                worst = np.full(len(q.ids) * asked, -2 ** 63, np.int64)
                last = np.flatnonzero(np.r_[held[0][1:] != held[0][:-1], True])
                worst[held[0][last]] = held[1][last]
                flat = least.reshape(-1)
                flat[full] = np.maximum(flat[full], worst[full])
                least = flat.reshape(-1, asked)
        return (*held, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                q, rows = Pack(row, "q_", refs, dims), Pack(row, "", refs, dims)
                wanted = np.frombuffer(row["q_wanted"], "<i8").reshape(len(q.ids), -1)
                question, score, found, asked = one(q, rows, wanted)
                a = question // asked
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.ids[a]), pa.array(q.hashes[a]), pa.array(question % asked, pa.int32()),
                     pa.array(score), pa.array(rows.ids[found])],
                    names=["anchor_id", "anchor_hash", "nth", "score", "id"])
    return run


def _meet(stored: DataFrame, asked: DataFrame, search) -> DataFrame:
    """Every slice against every block."""
    count = asked.agg(F.max("slice").alias("n")).first()["n"]
    if count is None:
        return stored.sparkSession.createDataFrame([], FOUND_SCHEMA)
    named = asked.select("slice", *[F.col(c).alias(f"q_{c}") for c in asked.columns if c != "slice"])
    pairs = (stored.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(count))))
             .join(maybe_broadcast(named), "slice").drop("slice"))
    return pairs.mapInArrow(search, FOUND_SCHEMA)


def _top(found: DataFrame, k: int) -> DataFrame:
    key = ["anchor_id", "anchor_hash", "nth"]
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


class Index:
    """The stored blocks of a table of vectors, and the two searches."""

    def __init__(self, rows: DataFrame, k: int = REFERENCES, fit_rows: int = FIT_ROWS, block: int = BLOCK,
                 window: int = WINDOW, slice_rows: int = SLICE):
        """``rows``: from ``prepared``."""
        self.window, self.slice_rows = window, slice_rows
        self.refs, self.sample = references(rows, k, fit_rows)
        self.dims = self.refs.shape[1]
        self.rows = materialize(located(rows, self.refs), "located")
        self.stored = blocks(self.rows, self.dims, block)

    def _ask(self, anchors: DataFrame, wants: Callable, same: bool, k: int) -> DataFrame:
        """``anchors`` (from ``located``, perhaps with further columns) against
        all rows; ``wants(batch, vectors)`` is what each is asked."""
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _unpack_v(batch.column("v").to_pylist(), dims)
                wanted = wants(batch, v)
                kept = batch.select(["id", "label", "hash", "size", "v", "angles"])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array([x.tobytes() for x in wanted.astype("<i8")], pa.binary())],
                    names=[*kept.schema.names, "wanted"])

        schema = "id long, label int, hash long, size double, v binary, angles binary, wanted binary"
        asked = slices(anchors.mapInArrow(run, schema), dims, self.slice_rows)
        return _top(_meet(self.stored, asked, _search(len(self.refs), dims, self.window, k, same)), k)

    def positives(self, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
        """``(anchor_id, anchor_hash, score, id, rank)``: the ``k`` best rows
        of the anchor's label.  The k-th best such row of the sample bounds the
        score from below."""
        sample = self.sample

        def wants(batch: pa.RecordBatch, v: np.ndarray) -> np.ndarray:
            score = products(v, sample["v"])
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            usable = (labels[:, None] == sample["labels"]) & (ids[:, None] != sample["ids"])
            score = np.where(usable, score, -2 ** 63)
            if score.shape[1] < k:
                return np.full((len(v), 1), -2 ** 63, np.int64)
            return np.partition(score, score.shape[1] - k, axis=1)[:, -k, None]
        return self._ask(anchors, wants, True, k).drop("nth")

    def negatives(self, anchors: DataFrame, positives: DataFrame, k: int = NEGATIVES, low: int = LOW_PERCENT,
                  high: int = HIGH_PERCENT) -> DataFrame:
        """``(anchor_id, anchor_hash, positive_id, positive_score, rank, id,
        score)``: for each positive the ``k`` best rows of another label with
        ``low * positive <= 100 * score <= high * positive``."""
        most = positives.agg(F.max("rank").alias("n")).first()["n"] or 1
        grouped = positives.groupBy("anchor_id", "anchor_hash").agg(
            F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
        grouped = materialize(grouped, "positives")
        key = (anchors["id"] == grouped["anchor_id"]) & (anchors["hash"] == grouped["anchor_hash"])
        asking = anchors.join(maybe_broadcast(grouped), key).withColumn("asked", F.col("positives.score"))

        def wants(batch: pa.RecordBatch, v: np.ndarray) -> np.ndarray:
            out = np.tile(np.array([1, 0], np.int64), (len(v), most))
            for at, scores in enumerate(batch.column("asked").to_pylist()):
                for nth, p in enumerate(scores):
                    out[at, 2 * nth:2 * nth + 2] = -(-low * p // 100), high * p // 100
            return out

        found = self._ask(asking.drop("positives", "anchor_id", "anchor_hash"), wants, False, k)
        of = grouped.select("anchor_id", "anchor_hash", F.posexplode("positives").alias("nth", "p"))
        return (found.join(maybe_broadcast(of), ["anchor_id", "anchor_hash", "nth"])
                .select("anchor_id", "anchor_hash", F.col("p.id").alias("positive_id"),
                        F.col("p.score").alias("positive_score"), "rank", "id", "score"))


def mine(rows: DataFrame, anchor: Column, **how) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)`` for the rows of ``rows`` (from ``prepared``) that meet
    ``anchor``, a condition on ``id`` and ``label``."""
    index = Index(rows, **how)
    anchors = materialize(index.rows.filter(anchor).dropDuplicates(["id", "hash"]), "anchors")
    positives = materialize(index.positives(anchors), "mined-positives")
    return index.negatives(anchors, positives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def op12_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 50 == 0)


def oracle() -> str:
    """DuckDB SQL for the query: every anchor against every row."""
    return f"""
WITH clean AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS alike,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM clean a JOIN clean r ON a.id % 50 = 0 AND r.id <> a.id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT alike AND {LOW_PERCENT} * positive_score <= 100 * score AND 100 * score <= {HIGH_PERCENT} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}"""
