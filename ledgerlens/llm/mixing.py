"""Mixing sources to target weights: soft-membership mixing.

The labelled table names each labelled document's domain; one FTRL classifier a
domain, over the features of ``features``, gives every document a posterior
over the domains.  The mix looks for a rate r >= 0 for each document (its
expected number of copies), near 1, such that the expected domain totals

    sum over documents of  r * tokens * posterior(domain)

match the targets.  That is least squares in as many unknowns as documents,
solved by projected gradient.  With the residual e of the totals (one number a
domain) every document steps to max(0, r + p . d) by itself.  The plain step
d = e / L, where L is the largest eigenvalue of the Gram matrix (sum of tokens
* p p'), never makes the squares larger.  Longer ones are tried beside it: 16
times the plain step, and a Newton step, whose Gram matrix is that of the rows
with a rate above 0, at three lengths.  One aggregation over the narrow table
of posteriors gives the residual and Gram matrix after each of them, and the
one with the least squares is taken.  The rates themselves never leave the
executors; they are a fold over the steps taken.

The fit ends when every total is within ``TOLERANCE``, or when the plain step
moves the rates by less than ``STILL`` (root mean square over tokens): then
the conditions of a minimum hold, and the targets cannot be reached by any
rates.  ``shortfall`` gives what each domain lacks, as a share of all tokens.

Tokens are the letter, digit and sign runs of ``features``.  Defined results:
a null or empty text has no tokens, the posterior of the bias alone and a rate
like any other; a label with a null, or of a missing document, trains nothing;
without any label all domains are equally likely; an empty table gives no rows;
rows that repeat id and text get the same rate, and each its copies; further
columns are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import features
from ledgerlens.llm.common import doc_key, materialize, maybe_broadcast, table
from ledgerlens.llm.toxicity import MODEL_LIMIT_BYTES, training_rows

# Share of the tokens that each domain is to have in the mix.
TARGETS = {"clean": 0.90, "low": 0.09, "toxic": 0.01}
MAX_TRAINING_ROWS = 6_000
TRAINING = features.Ftrl(passes=3)
TOLERANCE = 1e-4
STILL = 1e-4
# An end for targets out of reach whose rates still creep; the shortfall shows it.
MAX_STEPS = 100
PLAIN_LENGTHS = (1.0, 16.0)
NEWTON_LENGTHS = (1.0, 0.5, 0.25)
NO_MASS = 1e-6              # directions of the Gram matrix below this share of its largest have no tokens to move
FIT_SCHEMA = "domain int, places binary, weights binary, bias double"


def domain_of(domains: list[str]) -> Column:
    """A label row's domain as its number in ``domains``; null if it has none."""
    name = (F.when(F.col("quality").isNull() | F.col("toxic").isNull(), F.lit(None))
            .when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean"))
    return reduce(lambda c, i: c.when(name == domains[i], i), range(1, len(domains)), F.when(name == domains[0], 0))


def _fit(k: int, how: features.Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        labels: list[int] = []
        for part in features.slices(batches):
            rows += features.row_places(part.column("text").to_pylist())
            labels += part.column("label").to_pylist()
        for d in range(k if rows else 0):
            m = features.fit(rows, [int(x == d) for x in labels], how)
            yield pa.RecordBatch.from_pydict({
                "domain": pa.array([d], pa.int32()), "places": [m.places.astype("<i4").tobytes()],
                "weights": [m.weights.astype("<f4").tobytes()], "bias": [m.bias]})
    return run


def train(docs: DataFrame, labels: DataFrame, domains: list[str], limit: int = MAX_TRAINING_ROWS,
          how: features.Ftrl = TRAINING) -> list[features.Sparse]:
    """One model a domain, fitted in one task on at most ``limit`` labelled
    documents, chosen by a hash of the id."""
    rows = training_rows(docs, labels, domain_of(domains), limit)
    fitted = (rows.repartition(1).sortWithinPartitions("turn", "label", "text").select("text", "label")
              .mapInArrow(_fit(len(domains), how), FIT_SCHEMA).collect())  # a row a domain
    if sum(len(r["places"]) + len(r["weights"]) for r in fitted) > MODEL_LIMIT_BYTES:
        raise ValueError("the models are too large to send to every task; raise l1")
    none = features.Sparse(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    models = {r["domain"]: features.Sparse(np.frombuffer(r["places"], "<i4"), np.frombuffer(r["weights"], "<f4"),
                                           r["bias"]) for r in fitted}
    return [models.get(d, none) for d in range(len(domains))]


def posteriors(docs: DataFrame, models: list[features.Sparse]) -> DataFrame:
    """``(doc_id, tie, n_tokens, p)``: ``p`` adds up to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ms = sent.value
        scorer = features.Scorer(ms)
        for part in features.slices(batches):
            of, places, counts = features.hashed(part.column("text").to_pylist())
            p = scorer(of, places, len(counts))
            p /= p.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, len(ms), dtype=np.int32), p.ravel())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(counts), lists],
                                             names=["doc_id", "tie", "n_tokens", "p"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"),
                        F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, tie long, n_tokens long, p array<double>")


def _rates(steps: list[np.ndarray], p: list[Column]) -> Column:
    """The rate after ``steps``, from 1: a fold, so that the expression is of
    one size however many steps there are."""
    taken = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(taken, F.lit(1.0), lambda r, s: _step(r, p, [s[d] for d in range(len(p))])) if steps else F.lit(1.0)


def _step(r: Column, p: list[Column], step: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, [x * s for x, s in zip(p, step)], r))


def fit_rates(members: DataFrame, shares: list[float], max_steps: int = MAX_STEPS,
              tolerance: float = TOLERANCE) -> tuple[Column, list[float]]:
    """``(rate, shortfall)``: the rate of a row of ``members`` (``n_tokens``,
    ``p``) as a column, and what each domain lacks as a share of all tokens.
    The start is r = 1 for all."""
    k = len(shares)
    p, n = [F.col("p")[d] for d in range(k)], F.col("n_tokens")
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def outcomes(steps: list[np.ndarray], tries: list[np.ndarray]) -> tuple[list[tuple], float]:
        """Totals and Gram matrix of the positive rates after each of
        ``tries``, and how far the first moves the rates."""
        narrow = members.select(n.alias("n"), *[x.alias(f"p{d}") for d, x in enumerate(p)],
                                _rates(steps, p).alias("r"))
        q = [F.col(f"p{d}") for d in range(k)]
        tried = narrow.select("*", *[_step(F.col("r"), q, [F.lit(float(x)) for x in t]).alias(f"r{i}")
                                     for i, t in enumerate(tries)])
        sums = [F.sum((F.col("r0") - F.col("r")) ** 2 * F.col("n")), F.sum("n")]
        for i in range(len(tries)):
            live = F.when(F.col(f"r{i}") > 0, F.col("n")).otherwise(0)
            sums += [F.sum(F.col(f"r{i}") * F.col("n") * x) for x in q]
            sums += [F.sum(live * q[a] * q[b]) for a, b in pairs]
        moved, total, *got = [float(x or 0) for x in tried.agg(*sums).first()]
        out = []
        for i in range(len(tries)):
            own = got[i * (k + len(pairs)):(i + 1) * (k + len(pairs))]
            gram = np.zeros((k, k))
            for (a, b), x in zip(pairs, own[k:]):
                gram[a, b] = gram[b, a] = x
            out.append((np.array(own[:k]), gram))
        return out, (moved / total) ** 0.5 if total else 0.0

    steps: list[np.ndarray] = []
    [(got, gram)], _ = outcomes(steps, [np.zeros(k)])
    total = float(got.sum())  # posteriors add up to 1
    if not total:
        return F.lit(1.0), [0.0] * k
    largest = np.linalg.eigvalsh(gram)[-1]
    target = np.array(shares) / sum(shares) * total
    miss = target - got
    while len(steps) < max_steps and np.abs(miss).max() > tolerance * total:
        newton = np.linalg.pinv(gram, rcond=NO_MASS, hermitian=True) @ miss
        tries = [*[miss / largest * x for x in PLAIN_LENGTHS], *[newton * x for x in NEWTON_LENGTHS]]
        ends, moved = outcomes(steps, tries)
        if moved <= STILL:
            break
        best = min(range(len(tries)), key=lambda i: ((target - ends[i][0]) ** 2).sum())
        steps.append(tries[best])
        got, gram = ends[best]
        miss = target - got
    return _rates(steps, p), (miss / total).tolist()


def plan_mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """``(doc_id, tie, n_tokens, p, rate, copies, shortfall)`` of every
    document.  ``copies`` is the rate rounded up or down by a hash of the
    document, so that its expectation is the rate; ``shortfall`` is the same
    in all rows: what each domain lacks after the fit, as a share of all
    tokens (below 0: what it has too much)."""
    domains = list(targets)
    members = materialize(posteriors(docs, train(docs, labels, domains)), "posteriors")
    rate, shortfall = fit_rates(members, [targets[d] for d in domains])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "tie", F.lit("copies")), 11) / float(1 << 53)
    rated = members.withColumn("rate", rate).withColumn("shortfall", F.array(*map(F.lit, shortfall)))
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int"))
                            .cast("int"))


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """``docs``, all columns, each row as many times as it has copies."""
    plan = plan_mix(docs, labels, targets).filter("copies <> 1")
    changed = materialize(plan.select(doc_key(F.col("doc_id"), F.col("tie")).alias("__planned"),
                                      F.col("copies").alias("__copies")).distinct(), "copies")
    marked = docs.withColumn("__document_key", doc_key(F.col("doc_id"), F.xxhash64(F.col("text"))))
    small = maybe_broadcast(changed)
    joined = marked.join(small, marked["__document_key"] == small["__planned"], "left")
    times = F.coalesce("__copies", F.lit(1))
    out = joined.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_soft_membership_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shares = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    lacks = [F.col("shortfall")[i].alias(f"shortfall_{d}") for i, d in enumerate(TARGETS)]
    return plan.select("doc_id", "n_tokens", *shares, "rate", "copies", *lacks)
