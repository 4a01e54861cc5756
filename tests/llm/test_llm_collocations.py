"""Phrase collocations against brute force with whole numbers of any size, and edges."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def phrase_counts(rows):
    counts = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for at in range(len(words)):
                for size in range(1, min(C.DEPTH, len(words) - at) + 1):
                    counts[C.NO_LANG if lang is None else lang, tuple(words[at:at + size])] += 1
    return counts


def brute(rows, least, top=C.TOP):
    f = phrase_counts(rows)
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c if len(p) == 1 else 0
    chosen = {key: c for key, c in f.items() if len(key[1]) > 1 and c >= least}
    inside = Counter()
    for (lang, p), c in chosen.items():
        for size in range(2, len(p)):
            for at in range(len(p) - size + 1):
                key = lang, p[at:at + size]
                inside[key] = max(inside[key], c)
    out = []
    for lang in n:
        scored = []
        for (of, p), a in chosen.items():
            if of == lang and inside[of, p] < a:
                cuts = [(1000 * a * n[of] // (f[of, p[:k]] * f[of, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), f[of, p[:k]], f[of, p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s)
                for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mined(spark, rows, least, schema=SCHEMA, **how):
    return sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, schema), least, **how).collect())


def random_rows(seed, count=150):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "ünï", "日本", "a", "it's", "x\x00y"] + [f"w{i}" for i in range(20)]
    rows = []
    for i in range(count):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice([["hot", "pair"], ["one", "very", "common", "long", "passage", "here"],
                                 [rng.choice(vocabulary)], [rng.choice(vocabulary) + rng.choice(".,;:!?\n\r\x0b\x0c")]])
        rows.append((i, rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("seed,least,top", [(1, 3, C.TOP), (2, 10, 5)])
def test_against_brute_force(spark, seed, least, top):
    rows = random_rows(seed)
    expected = brute(rows, least, top)
    assert mined(spark, rows, least, top=top) == expected and len(expected) >= 5


def test_crowded_leading_words_go_deeper(spark):
    """A third of all suffixes share a pair, most of those a third word."""
    rng = random.Random(3)
    rows = [(i, "the same " + rng.choice(["old ", "old ", "old ", "new "]) + f"w{rng.randrange(9)} v{rng.randrange(9)}",
             "en") for i in range(900)]
    found = C._spoken(spark.createDataFrame(rows, SCHEMA), "text", "lang")
    vocabulary = C.Vocabulary(found, 5)
    stored = C.suffixes(found, vocabulary)
    names = {r["id"]: r["word"] for r in vocabulary.words.collect()}
    got = {tuple(names[x] for x in r[:5] if x): r["n"] for r in C.frequent(stored, 5, 50).collect()}
    assert got == {p: c for (_, p), c in phrase_counts(rows).items() if c >= 5 and len(p) > 1}
    assert mined(spark, rows, 5, partition_rows=50) == brute(rows, 5)


def test_edges_and_clashing_columns(spark, edges):
    rows = [(i, t, None if i == 3 else "en") for i, t in edges] * 3 + [(1, "", ""), (2, None, ""), (3, "a b a b", "")]
    assert mined(spark, [], 1) == []
    names = ["phrase", "n", "a", "w1", "id", "word", "rank", "key", "level"]
    wide = [(*r, *[1] * len(names)) for r in rows]
    assert mined(spark, wide, 2, SCHEMA + "".join(f", {c} int" for c in names)) == brute(rows, 2)


def test_colliding_ids_take_another_seed(spark):
    rows = random_rows(5, 30)
    assert mined(spark, rows, 3, id_bits=14) == brute(rows, 3)
    with pytest.raises(ValueError, match="seed"):
        mined(spark, rows, 3, id_bits=3)


def test_long_texts_and_full_buffers_lose_no_suffix(monkeypatch):
    rows = random_rows(6, 60)
    everything = np.full(1 << C.BITS >> 3, 255, np.uint8)

    class Sent:
        value = everything

    def total():
        batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]})
        out = Counter()
        for b in C._suffixes("0", (1 << 64) - 1, Sent)(iter([batch])):
            for r in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                out[r[:-1]] += r[-1]
        return out

    whole = total()
    monkeypatch.setattr(C, "BUFFER", 37)
    monkeypatch.setattr(C, "SLICE_BYTES", 11)
    monkeypatch.setattr(C, "REMEMBERED", 10)
    assert total() == whole and sum(whole.values()) == sum(
        c for (_, p), c in phrase_counts(rows).items() if len(p) == 2)


def test_quicksort_counts():
    rng = np.random.default_rng(7)
    columns = [rng.integers(0, 4, 500) for _ in range(3)]
    for before, after in zip(columns, columns[1:]):
        after[before == 0] = 0
    n = rng.integers(1, 5, 500)
    expected = Counter()
    for *words, c in zip(*columns, n):
        for size in range(1, 4):
            if words[size - 1]:
                expected[tuple(map(int, words[:size]))] += int(c)
    at, length, count = C.quicksort(columns, n, 40)
    got = {tuple(int(columns[k][i]) for k in range(size)): c for i, size, c in zip(at, length, count)}
    assert got == {p: c for p, c in expected.items() if c >= 40}


def test_only_suffixes_that_can_be_frequent_are_routed(spark, monkeypatch):
    """Frequent pairs in changing company: each triple is rare, so that the
    suffixes of three words and more need not meet in a task."""
    rows = [(i, f"a b. b c. a b c x{i % 3}" if i < 30 else f"a b c{i % 40}. b c{i % 40} y", "en") for i in range(300)]
    found = C._spoken(spark.createDataFrame(rows, SCHEMA), "text", "lang")
    seen = {}

    def stored(df, kind, real=C.materialize):
        seen[kind] = real(df, kind)
        return seen[kind]

    monkeypatch.setattr(C, "materialize", stored)
    vocabulary = C.Vocabulary(found, 5)
    names = {r["id"]: r["word"] for r in vocabulary.words.collect()}
    got = {tuple(names[x] for x in r[:5] if x): r["n"] for r in C.frequent(C.suffixes(found, vocabulary), 10).collect()}
    counts = phrase_counts(rows)
    assert got == {p: c for (_, p), c in counts.items() if c >= 10 and len(p) > 1}
    routed = seen["routed"].collect()
    # before: every "a b c<k>" and "b c<k> y" too, of 6 or 7 occurrences each
    assert {tuple(names[x] for x in r[:5] if x) for r in routed} == {p for p in got if len(p) == 4 or p == ("b", "c", "x0")
                                                                     or p == ("b", "c", "x1") or p == ("b", "c", "x2")}


@pytest.mark.parametrize("bits", [16, 18])
def test_sketch_has_every_frequent_lead(spark, bits, monkeypatch):
    monkeypatch.setattr(C, "SKETCH_ROWS", 50)
    rng = random.Random(9)
    rows = []
    for _ in range(600):
        w = [rng.randrange(1, 9) * 2654435761 | 1 for _ in range(C.DEPTH)]
        size = rng.randrange(2, C.DEPTH + 1)
        rows.append((*w[:size], *[0] * (C.DEPTH - size), rng.randrange(1, 300)))
    stored = spark.createDataFrame(rows, C.SUFFIX_SCHEMA).repartition(4)
    for least in (1, 100, 1000):
        got = C.sketch(stored, [2, 3, 5], bits, least)
        for depth, sent in got.items():
            total = Counter()
            for *w, n in rows:
                if w[depth - 1]:
                    key = C.leads([np.array([x], np.int64) for x in w], depth)[0] & np.uint64((1 << bits) - 1)
                    total[int(key)] += n
            assert set(np.flatnonzero(np.unpackbits(sent.value, bitorder="little"))) == {
                k for k, n in total.items() if n >= least}
