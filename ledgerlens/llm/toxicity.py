"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

``train`` takes the labelled documents, at most ``MAX_TRAINING_ROWS`` of them
(a documented bound on the rows fitted, chosen by a hash of the id, then of id
and text where ids have several) and fits in one task; the L1 term leaves a few thousand weights, whose
size is checked before they are sent to the tasks.  ``score`` runs over all
documents in one pass without a shuffle.

The text is the only input of a score.  Defined results: a null text scores as
an empty one (the bias alone); a null label, or a label whose document is
missing, is no training row; rows of one id, text and label are one training
row; without any training row every score is 0.5; null ids are
scored like others; further columns are kept by ``filter_toxic`` and left out
of ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import features
from ledgerlens.llm.common import doc_key, materialize, maybe_broadcast, table

MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7
MODEL_LIMIT_BYTES = 64 * 1024 * 1024
MODEL_SCHEMA = "places binary, weights binary, bias double"


def held_out(doc_id: Column) -> Column:
    """The rows that are never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: Column, limit: int) -> DataFrame:
    """``(text, label, turn)`` of at most ``limit`` labelled documents that are
    not held out; ``turn`` is the hash of the id that also sets the order.
    Rows of one id, text and label are one.  ``limit`` bounds the labels, and
    then the rows that they meet (by a hash of id and text)."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label"))
              .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .withColumn("turn", F.xxhash64("doc_id"))
              .orderBy("turn", "label").limit(limit))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"),
                        F.col("text").cast("string").alias("text"))
    small = maybe_broadcast(chosen.distinct())
    met = texts.select("id", "tie").join(small, F.col("id") == small["doc_id"]).select("id", "tie", "label", "turn")
    # the bound holds for the joined rows; their keys are chosen before any text is moved
    bounded = maybe_broadcast(materialize(met.distinct().orderBy(F.xxhash64("id", "tie"), "label", "id", "tie")
                                          .limit(limit), "training"))
    return (texts.join(bounded, ["id", "tie"]).groupBy("id", "tie", "label", "turn").agg(F.first("text").alias("text"))
            .select("text", "label", "turn"))


def _fit(how: features.Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        labels: list[int] = []
        for part in features.slices(batches):
            rows += features.row_places(part.column("text").to_pylist())
            labels += part.column("label").to_pylist()
        if rows:
            m = features.fit(rows, labels, how)
            yield pa.RecordBatch.from_pydict({"places": [m.places.astype("<i4").tobytes()],
                                              "weights": [m.weights.astype("<f4").tobytes()], "bias": [m.bias]})
    return run


def train(docs: DataFrame, labels: DataFrame, label: Column | None = None, limit: int = MAX_TRAINING_ROWS,
          how: features.Ftrl = features.Ftrl()) -> features.Sparse:
    """Fit on the labelled documents.  The rows of the bounded sample meet in
    one task, in the order of a hash; only the weights reach the driver."""
    rows = training_rows(docs, labels, F.col("toxic") if label is None else label, limit)
    model = (rows.repartition(1).sortWithinPartitions("turn", "label", "text").select("text", "label")
             .mapInArrow(_fit(how), MODEL_SCHEMA).first())
    if model is None:
        return features.Sparse(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    if len(model["places"]) + len(model["weights"]) > MODEL_LIMIT_BYTES:
        raise ValueError("the model is too large to send to every task; raise l1")
    return features.Sparse(np.frombuffer(model["places"], "<i4"), np.frombuffer(model["weights"], "<f4"),
                           model["bias"])


def score(docs: DataFrame, model: features.Sparse, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tie, score)`` for every document; ``tie`` is a hash of the
    text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = features.Scorer([sent.value])
        for part in features.slices(batches):
            of, places, counts = features.hashed(part.column("text").to_pylist(), sent.value.bits)
            p = scorer(of, places, len(counts))[:, 0]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(p, pa.float64())],
                                             names=["doc_id", "tie", "score"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"),
                        F.col(text_col).cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, tie long, score double")


def filter_toxic(docs: DataFrame, model: features.Sparse, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or
    more.  Only the rejected keys (id and hash of the text) are shuffled."""
    rejected = materialize(score(docs, model).filter(F.col("score") >= threshold)
                           .select(doc_key(F.col("doc_id"), F.col("tie")).alias("rejected")).distinct(), "rejected")
    marked = docs.withColumn("__document_key", doc_key(F.col("doc_id"), F.xxhash64(F.col("text"))))
    bad = maybe_broadcast(rejected)
    return marked.join(bad, marked["__document_key"] == bad["rejected"], "left_anti").drop("__document_key")


def op8_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
