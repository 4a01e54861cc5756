import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import features, mixing, toxicity
from ledgerlens.llm.common import table

SF = "/root/testdata/sf0.01"


def naive_ftrl(rows, labels, how, bits):
    """FTRL-proximal one coordinate at a time, as published."""
    z, n = {}, {}
    share = min(max(sum(labels) / len(labels), 1e-3), 1 - 1e-3)
    bias, bias_n = np.log(share / (1 - share)), 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= how.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.passes):
        for x, y in zip(rows, labels):
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y
            for i in x:
                sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / how.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= how.alpha * g / (how.beta + np.sqrt(bias_n))
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_is_the_published_update():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 60, 8)) for _ in range(300)]
    labels = [int(3 in r or 5 in r) for r in rows]
    how = features.Ftrl(alpha=0.5, beta=1.0, l1=0.7, l2=0.1, passes=2)
    got = features.fit(rows, labels, how, bits=6)
    weights, bias = naive_ftrl(rows, labels, how, 6)
    assert dict(zip(got.places.tolist(), got.weights.tolist())) == pytest.approx(weights, rel=1e-5)
    assert got.bias == pytest.approx(bias)
    assert 0 < len(got.places) < 60  # L1 leaves some out


def test_features_are_ngrams_and_skipgrams():
    of, places, counts = features.hashed(["a b c", "b", None, "A  b"])
    assert counts.tolist() == [3, 1, 0, 2]
    sets = [set(places[of == i].tolist()) for i in range(4)]
    assert len(sets[0]) == 3 + 2 + 1 and len(sets[1]) == 1 and not sets[2]
    assert len(sets[3] & sets[0]) == 3  # a, b and the pair


def test_scorer_counts_a_feature_once():
    a = features.Sparse(np.array([1, 3]), np.array([1.0, 2.0], np.float32), 0.5, bits=2)
    b = features.Sparse(np.array([2]), np.array([-1.0], np.float32), 0.0, bits=2)
    of, places = np.array([0, 0, 0, 2]), np.array([1, 1, 2, 3])
    want = features.sigmoid(np.array([[1.5, -1.0], [0.5, 0.0], [2.5, 0.0]]))
    assert features.Scorer([a, b])(of, places, 3) == pytest.approx(want)


@pytest.fixture(scope="module")
def toxic(spark):
    return {r["doc_id"]: r for r in toxicity.op8_toxicity_ftrl(spark, "/root/testdata/sf0.1").collect()}


def test_op8_held_out_accuracy(spark, toxic):
    """On rows that were never learnt from."""
    labels = [tuple(r) for r in table(spark, "/root/testdata/sf0.1", "labels").select("doc_id", "toxic").collect()]
    rows = [(toxic[d]["score"], y, toxic[d]["predicted"]) for d, y in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(toxic[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in labels)
    positive = [s for s, y, _ in rows if y]
    negative = [s for s, y, _ in rows if not y]
    auc = np.mean([[p > q for q in negative] for p in positive])
    assert auc > 0.95
    hits = [y for _, y, p in rows if p]
    assert np.mean(hits) > 0.95 and sum(hits) > 0.6 * len(positive)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in toxic.values())


def test_op8_edges(spark, write, edges):
    labels = [(i, 1, i % 2) for i in range(1, 40)] + [(5, None, None), (None, 1, 1), (999, 1, 1), (1, 0, 0)]
    sf = write(documents=edges, labels=labels)
    got = toxicity.op8_toxicity_ftrl(spark, sf).collect()
    assert len(got) == len(edges) and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r, (i, t) in zip(sorted(got, key=lambda r: repr(r["doc_id"])), sorted(edges, key=lambda e: repr(e[0]))):
        by_text.setdefault(t or "", set()).add(r["score"]) if i not in (8, 9, None) else None
    assert all(len(v) == 1 for v in by_text.values())
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert {r["score"] for r in toxicity.op8_toxicity_ftrl(spark, write(documents=edges, labels=[])).collect()} == {0.5}
    assert toxicity.op8_toxicity_ftrl(spark, write(documents=[], labels=labels)).count() == 0


def test_filter_toxic_drops_what_scores_high_and_keeps_columns(spark, write):
    docs = [(i, t) for i, t in enumerate(["bad word here", "a good text", None, "bad", ""])] + [(None, "bad thing")]
    sf = write(documents=docs)
    df = table(spark, sf, "documents").withColumn("tie", F.lit(1)).withColumn("score", F.lit("x"))
    place = features.row_places(["bad"])[0]
    model = features.Sparse(place, np.full(len(place), 5.0, np.float32), -2.0)
    got = toxicity.filter_toxic(df, model)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 4]


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([2, 1, 0.5], 2000)
    n = rng.integers(0, 500, 2000)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    shares = [0.5, 0.2, 0.3]
    rate, miss = mixing.fit_rates(df, shares)
    rows = df.withColumn("rate", rate).collect()
    r = np.array([x["rate"] for x in rows])
    w, q = np.array([x["n_tokens"] for x in rows]), np.array([x["p"] for x in rows])
    assert r.min() >= 0 and np.abs(miss).max() <= mixing.TOLERANCE
    totals = (r * w) @ q / n.sum()
    assert totals == pytest.approx(shares, abs=2 * mixing.TOLERANCE)


def brute_rates(n, p, shares, steps=20000):
    """Plain projected gradient, gone on with until it is at rest."""
    total = n.sum()
    largest = np.linalg.eigvalsh((p * n[:, None]).T @ p)[-1]
    target, r = np.array(shares) / sum(shares) * total, np.ones(len(n))
    for _ in range(steps):
        r = np.maximum(0, r + p @ (target - (r * n) @ p) / largest)
    return r, (target - (r * n) @ p) / total


def test_op2_against_brute_force(spark):
    rows = mixing.op2_soft_membership_mix(spark, SF).collect()
    p = np.array([[r[f"p_{d}"] for d in mixing.TARGETS] for r in rows])
    n = np.array([r["n_tokens"] for r in rows], dtype=float)
    assert len(rows) == table(spark, SF, "documents").count()
    assert p.sum(axis=1) == pytest.approx(1)
    shares = list(mixing.TARGETS.values())
    got = np.array([r["rate"] for r in rows])
    assert got.min() >= 0
    reached = (got * n) @ p / n.sum()
    best, left = brute_rates(n, p, shares)
    assert np.abs(left).max() < 1e-4  # these targets can be reached
    assert reached == pytest.approx(shares, abs=1.01 * mixing.TOLERANCE)
    assert reached == pytest.approx((best * n) @ p / n.sum(), abs=2 * mixing.TOLERANCE)
    lacks = [rows[0][f"shortfall_{d}"] for d in mixing.TARGETS]
    assert lacks == pytest.approx(np.array(shares) - reached, abs=1e-9)
    copies = np.array([r["copies"] for r in rows])
    assert ((copies >= np.floor(got)) & (copies <= np.ceil(got))).all()


def members(spark, n, p):
    return spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)],
                                 "n_tokens long, p array<double>").coalesce(1).cache()


def test_targets_out_of_reach_are_shown(spark):
    """No document is more than 30 % of the third domain, which is to have 60 %."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([2, 2, 1], 300)
    p[:, 2] = np.minimum(p[:, 2], 0.3)
    p[:, :2] *= ((1 - p[:, 2]) / p[:, :2].sum(axis=1))[:, None]
    n = rng.integers(1, 400, 300)
    df = members(spark, n, p)
    rate, lacks = mixing.fit_rates(df, [0.2, 0.2, 0.6], max_steps=40)
    r = np.array([x["rate"] for x in df.withColumn("rate", rate).collect()])
    assert r.min() >= 0
    assert lacks == pytest.approx(np.array([0.2, 0.2, 0.6]) - (r * n) @ p / n.sum(), abs=1e-9)
    _, left = brute_rates(n.astype(float), p, [0.2, 0.2, 0.6])
    assert max(left) > 0.05  # out of reach
    assert lacks == pytest.approx(left, abs=2e-3)


def test_a_domain_without_mass_moves_no_rate_far(spark):
    p = np.tile([0.7, 0.3, 0.0], (50, 1))
    p[25:] = [0.2, 0.8, 0.0]
    df = members(spark, np.full(50, 10), p)
    rate, lacks = mixing.fit_rates(df, [0.5, 0.4, 0.1], max_steps=20)
    r = np.array([x["rate"] for x in df.withColumn("rate", rate).collect()])
    assert lacks[2] == pytest.approx(0.1) and 0 <= r.min() and r.max() < 3


def test_op2_domains_are_learnt(spark):
    """Held-out posteriors tell clean from low-quality text."""
    rows = {r["doc_id"]: r for r in mixing.op2_soft_membership_mix(spark, "/root/testdata/sf0.1").collect()}
    labels = [tuple(r) for r in table(spark, "/root/testdata/sf0.1", "labels").collect()]
    held = [(d, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    low = [rows[d]["p_low"] for d, q in held if q == 0]
    good = [rows[d]["p_low"] for d, q in held if q == 1]
    assert np.mean([[a > b for b in good] for a in low]) > 0.9


def test_op2_edges(spark, write, edges):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(1, 30)] + [(5, None, 1), (None, 1, 1), (999, 1, 1)]
    sf = write(documents=edges, labels=labels)
    assert mixing.op2_soft_membership_mix(spark, sf).count() == len(edges)
    assert mixing.op2_soft_membership_mix(spark, write(documents=edges, labels=[])).count() == len(edges)
    assert mixing.op2_soft_membership_mix(spark, write(documents=[], labels=labels)).count() == 0


def test_mix_repeats_and_drops_rows(spark, write, edges, monkeypatch):
    sf = write(documents=edges, labels=[(1, 1, 0)])
    docs = table(spark, sf, "documents").withColumn("copies", F.lit("x"))
    plan = docs.select("doc_id", F.xxhash64("text").alias("tie"),
                       F.when(F.col("doc_id") == 7, 0).when(F.col("doc_id").isNull(), 2).otherwise(1).alias("copies"))
    monkeypatch.setattr(mixing, "plan_mix", lambda *a: plan)
    got = mixing.mix(docs, None)
    assert got.columns == docs.columns
    want = [i for i, _ in edges if i != 7] + [None, None]
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_slices_cover_every_row():
    b = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "", "y" * features.SLICE_BYTES, "z"]})
    assert [r for s in features.slices([b]) for r in s.column("text").to_pylist()] == b.column("text").to_pylist()


def test_training_rows_are_bounded_after_the_join(spark, write):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:20]
    docs = [(i, f"text {i}") for i in ids] + [(ids[0], f"text {ids[0]}")] * 30 + [(ids[1], f"other {k}") for k in range(40)]
    sf = write(documents=docs, labels=[(i, 1, i % 2) for i in ids] * 2)
    tables = [spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels")]

    def rows(limit):
        return [r["text"] for r in toxicity.training_rows(*tables, F.col("toxic"), limit).collect()]

    assert sorted(rows(100)) == sorted({t for _, t in docs})
    assert len(rows(25)) == len(set(rows(25))) == 25
