import random
import re

import numpy as np
import xxhash
from llm_data import DOC, doc_rows
from pyspark.sql import types as T

from ledgerlens.llm import simhash
from ledgerlens.llm.components import connected_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """Root and least id of each fingerprint's class; prints: [(id, fingerprint)]."""
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = np.array(distinct, dtype=np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= 2):
            parent[find(distinct[i + 1 + int(j)])] = find(f)
    least = {}
    for d, f in prints:
        r = find(f)
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return {f: (find(f), least.get(find(f))) for f in distinct}


def near_copies(n, seed=1, words=400):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        w[rng.randrange(words)] = f"x{i}"
        out.append((1000 + i, " ".join(w)))
    return out


def test_op9_edges_and_near_copies(spark, write, edges):
    docs = edges + near_copies(120)
    got = simhash.op9_simhash_blocks(spark, write(documents=docs)).collect()
    prints = [(d, brute_print(t)) for d, t in docs]
    least = brute_classes(prints)
    want = sorted((repr(d), f"{f:016x}", repr(least[f][1])) for d, f in prints)
    assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in got) == want
    assert simhash.op9_simhash_blocks(spark, write(documents=[])).count() == 0


def test_crowded_keys_lose_no_link(spark):
    """The same classes whichever keys count as crowded."""
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(400):  # a cloud in which most keys are shared by many
        p = rng.choice(sorted(prints))
        for _ in range(rng.randrange(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    rows = [(i, 0, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "doc_id long, tie long, fp long")
    least = brute_classes([(i, p) for i, p in enumerate(sorted(prints))])
    want = sorted((i, least[p][1]) for i, p in enumerate(sorted(prints)))
    for crowd in (1, 8, 10_000):
        labels = connected_components(simhash.links(df.select("fp"), crowd=crowd))
        roots = {r["node"]: r["root"] for r in labels.collect()}
        group = {}
        for i, _, fp in rows:
            group.setdefault(roots.get(fp, fp), []).append(i)
        assert sorted((i, min(g)) for g in group.values() for i in g) == want


def test_every_bit_difference_up_to_two_is_linked(spark):
    base = 0x0123456789ABCDEF
    near = [base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(i + 1, 64, 7)]
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in {base, *near}]
    pairs = simhash.links(spark.createDataFrame(rows, "fp long")).collect()
    assert sum(base in (r["a"], r["b"]) for r in pairs) == len(set(near))


def test_majority_bits_of_a_very_long_text():
    rng = np.random.default_rng(0)
    counts = np.array([0, 3, 140_000, 1, 0])
    h = rng.integers(0, 2**63, counts.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got, at = simhash.majority_bits(h, counts), 0
    for g, n in zip(got, counts):
        bits = np.unpackbits(h[at:at + n].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) if n else []
        assert int(g) == sum(1 << i for i in range(64) if n and 2 * bits[i] > n)
        at += n


def test_components_of_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)] + [(300, 7)]
    odd = [(5, 5), (None, 3), (2, 1), (1, 2), (1, 2)]
    got = connected_components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert roots == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in [*range(200, 260), 300]}, 2: 1}


def test_survivors_keep_one_of_each_class(spark, edges):
    df = spark.createDataFrame([(*r, "x") for r in doc_rows(edges)], T.StructType([*DOC.fields, T.StructField(
        "kept", T.StringType())]))
    got = simhash.survivors(df).collect()
    least = brute_classes([(d, brute_print(t)) for d, t in edges])
    assert list(got[0].asDict()) == df.columns
    # a class for each root; two of them may have the same id
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(i) for _, i in set(least.values()))
