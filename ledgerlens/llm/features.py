"""Hashed word features and an FTRL-proximal learner, shared by the toxicity
scorer and the mixing classifier.

A text's tokens are runs of letters, of digits and of other signs, lower-cased.
Features are hashed to ``2**bits`` places: every token, every pair of
neighbours (2-gram) and every pair with one token between (skip-gram).  A
feature counts once a text, however long the text is."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BITS = 21
TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
REMEMBERED = 100_000
SLICE_BYTES = 1 << 20
# Odd multipliers that set the three kinds of feature apart.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = value = zlib.crc32(token.encode())
        return value


_HASHES = _Hashes()


def hashed(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, place)`` of every feature occurrence, and the number of
    tokens of each text."""
    get = _HASHES.__getitem__
    lists = [list(map(get, TOKENS((t or "").lower()))) for t in texts]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    h = np.fromiter(chain.from_iterable(lists), dtype=np.uint64, count=int(counts.sum()))
    of = np.repeat(np.arange(len(texts)), counts)
    shift = np.uint64(64 - bits)
    places, owners = [(h + np.uint64(1)) * MIX[0] >> shift], [of]
    for gap in (1, 2):
        same = of[gap:] == of[:-gap]
        mixed = (h[:-gap] * MIX[0] + h[gap:] * MIX[gap] + np.uint64(gap)) * MIX[gap] >> shift
        places.append(mixed[same])
        owners.append(of[gap:][same])
    return np.concatenate(owners), np.concatenate(places).astype(np.int64), counts


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``SLICE_BYTES`` of ``column``."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(size):
            before = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


@dataclass(frozen=True)
class Ftrl:
    """Settings of FTRL-proximal: learning rate, its offset, L1, L2, passes."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    passes: int = 6


@dataclass(frozen=True)
class Sparse:
    """A fitted model: the places with a weight, their weights, the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, dtype=np.float32)
        out[self.places] = self.weights
        return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit(rows: list[np.ndarray], labels: list[int], how: Ftrl = Ftrl(), bits: int = BITS) -> Sparse:
    """FTRL-proximal logistic regression over rows of distinct places, each
    with its own learning rate; the bias has no L1.  The rows are taken in the
    order given, in every pass."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    share = min(max(float(np.mean(labels)) if labels else 0.5, 1e-3), 1 - 1e-3)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0
    for _ in range(how.passes):
        for x, y in zip(rows, labels):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= how.l1, 0.0,
                         (np.sign(zx) * how.l1 - zx) / ((how.beta + root) / how.alpha + how.l2))
            g = float(sigmoid(bias + w.sum())) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / how.alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= how.alpha * g / (how.beta + bias_n ** 0.5)
    on = np.flatnonzero(np.abs(z) > how.l1)
    w = (np.sign(z[on]) * how.l1 - z[on]) / ((how.beta + np.sqrt(n[on])) / how.alpha + how.l2)
    return Sparse(on, w.astype(np.float32), bias, bits)


def row_places(texts: list[str | None], bits: int = BITS) -> list[np.ndarray]:
    """The distinct places of each text."""
    of, places, _ = hashed(texts, bits)
    key = np.unique(of * (1 << bits) + places)
    cuts = np.searchsorted(key >> bits, np.arange(1, len(texts)))
    return np.split((key & ((1 << bits) - 1)).astype(np.int32), cuts)  # views of one array a slice


class Scorer:
    """Scores texts by several models at once.  Few places have a weight, so
    one small table of flags picks the features that matter."""

    def __init__(self, models: list[Sparse]):
        self.tables = [m.dense() for m in models]
        self.biases = [m.bias for m in models]
        self.used = np.any([t != 0 for t in self.tables], axis=0)

    def __call__(self, of: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Probability of each of ``n`` texts under each model, from ``hashed``."""
        on = self.used[places]
        key = np.unique(of[on] * len(self.used) + places[on])
        text, place = key // len(self.used), key % len(self.used)
        return sigmoid(np.stack([b + np.bincount(text, weights=t[place], minlength=n)
                                 for t, b in zip(self.tables, self.biases)], axis=1))
