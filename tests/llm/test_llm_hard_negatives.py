"""Hard-negative mining against brute force, and its edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=5, k=H.POSITIVES, n=H.NEGATIVES):
    clean = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
             if i is not None and label is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in clean if i % every == 0}:
        scored = sorted(((-score(v, w), j, other) for j, other, w in clean if j != i))
        for s, j, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:n]
            out += [(i, j, at + 1, neg, -s, -t) for at, (t, neg, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, every=5, **how):
    frame = H.prepared(spark.createDataFrame(rows, schema))
    return sorted(tuple(r) for r in H.mine(frame, F.col("id") % every == 0, **how).collect())


def random_rows(seed, count=90, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.5, 0.0]) for _ in range(dims)], rng.randrange(3))
            for i in range(count)]
    return rows + [(count + i, rows[i % 7][1], i % 3) for i in range(20)]   # ties: equal vectors, other ids


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_over_many_blocks_and_slices(spark, seed):
    rows = random_rows(seed)
    assert mined(spark, rows, block=16, window=3, slice_rows=4, k=3, fit_rows=20) == brute(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = random_rows(3, 25) + [(None, [1.0] * 6, 1), (200, None, 1), (205, [1.0] * 6, None), (210, [], 1),
                                 (215, [1.0, None], 1), (220, [inf] * 6, 1), (225, [nan] * 6, 1),
                                 (230, [0.0] * 6, 2), (235, [0.5], 0), (240, [-0.5] * 6, 1)]
    rows += [(300, [0.9] * 6, 0)] * 3 + [(301, [0.9] * 6, 0)] * 2 + [(302, [0.7] * 6, 1)] * 2  # repeated rows
    assert mined(spark, rows, block=8, window=2) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, [], SCHEMA) == []
    rows = random_rows(4, 30)
    names = ["rank", "score", "near", "slice", "anchor_id", "hash", "id"]
    wide = [(*r, *[7] * len(names)) for r in rows]
    schema = SCHEMA + "".join(f", {c} int" for c in names)
    assert mined(spark, wide, schema) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 20 + 7 * i), float(i - 20), 3.0], i % 2) for i in range(0, 41)]
    assert mined(spark, rows, block=8, window=2) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, [1e30], 0), (1, [1e30], 0)])


def test_bounds_hold_every_score():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(size=(200, 8)) * rng.choice([0, 0.01, 1, 50], size=(200, 1)))
    refs = rng.normal(size=(4, 8))
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)
    size = np.linalg.norm(v, axis=1)
    angles = np.arccos(np.clip(v @ refs.T / np.where(size > 0, size, 1)[:, None], -1, 1)).astype("<f4")
    row = {"ids": np.arange(200, dtype="<i8").tobytes(), "labels": np.zeros(200, "<i4").tobytes(),
           "hashes": np.zeros(200, "<i8").tobytes(), "sizes": size.astype("<f8").tobytes(),
           "v": v.astype("<f8").tobytes(), "angles": angles.tobytes()}
    pack = H.Pack(row, "", 4, 8)
    below, above = H.bounds(pack, pack, 7)
    score = v @ v.T
    window = np.arange(200) // 7
    assert (score <= above[:, window]).all() and (score >= below[:, window]).all()


def test_windows_are_passed_over():
    """On clustered vectors most windows never get integer scoring."""
    rng = np.random.default_rng(6)
    centres = np.eye(8)
    v = np.floor(256 * (centres[np.repeat(np.arange(8), 64)] + 0.01 * rng.normal(size=(512, 8))))
    size = np.linalg.norm(v, axis=1)
    angles = np.arccos(np.clip(v @ centres.T / size[:, None], -1, 1)).astype("<f4")
    row = {"ids": np.arange(512, dtype="<i8").tobytes(), "labels": np.zeros(512, "<i4").tobytes(),
           "hashes": np.zeros(512, "<i8").tobytes(), "sizes": size.tobytes(), "v": v.astype("<i4").tobytes(),
           "angles": angles.tobytes()}
    pack = H.Pack(row, "", 8, 8)
    _, above = H.bounds(pack, pack, 64)
    assert (above >= 0.5 * 256 * 256).mean() < 0.2
