import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerlens.llm import decontam

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s:s + n])].add("null" if i is None else str(i))
    sizes = sorted({len(k) for k in windows})
    out = []
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    met |= windows[tuple(w[s:s + n])]
        sha = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(met), sha, bool(hit)))
    return sorted(out, key=repr)


def result(spark, sf):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in cols) for r in decontam.op10_positional_index(spark, sf).collect()), key=repr)


def test_op10_given_tables(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert result(spark, SF) == brute(pairs, items)


def test_op10_edges(spark, write, edges):
    rng = random.Random(3)
    few = [" ".join(rng.choice("a b c d".split()) for _ in range(60)) for _ in range(30)]  # ties and overlaps
    docs = edges + [(100 + i, t) for i, t in enumerate(few)] + [(None, few[0]), (150, few[1]), (150, few[1])]
    items = [(1, "beta GAMMA, delta epsilon zeta eta theta iota kappa alpha"), (2, "one"), (3, None), (4, ""),
             (5, "...!"), (None, "space Ünïcode"), (6, "b a b a"), (6, "c d a"), (7, "b a b a"),
             (8, few[2]), (9, " ".join(["a"] * 12)), (10, "never seen anywhere"), (2, "one")]
    sf = write(documents=docs, benchmark=items)
    assert result(spark, sf) == brute(docs, items)
    assert result(spark, write(documents=[], benchmark=items)) == []
    assert all(not r[-1] for r in result(spark, write(documents=docs, benchmark=[])))


def test_drop_contaminated_keeps_the_rest_and_all_columns(spark, write, edges):
    items = [(1, "one"), (2, "no id at all")]
    sf = write(documents=edges, benchmark=items)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("leak", F.lit(1)).withColumn("pid", F.lit(2))
    got = decontam.drop_contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert got.columns == docs.columns
    want = [d for d, t in edges if "one" not in words(t) and words(t)[:2] != ["no", "id"]]
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_shuffle_joins_give_the_same_rows(spark, write, edges, monkeypatch):
    items = [(1, "beta gamma delta epsilon zeta eta theta iota"), (2, "one")]
    sf = write(documents=edges, benchmark=items)
    want = result(spark, sf)
    monkeypatch.setattr(decontam, "maybe_broadcast", lambda df, *a: df)
    assert result(spark, sf) == want


def test_a_large_benchmark_shuffles_what_may_be_wanted(spark, write, edges, monkeypatch):
    """Beyond the broadcast limit, words pass a bitmap before they are shuffled."""
    docs, items = near_tables(random.Random(7))
    sf = write(documents=docs + edges, benchmark=items)
    split = decontam.split_words(decontam.keyed(spark.read.parquet(f"{sf}/documents.parquet")))
    every = split.select("doc", F.posexplode("h").alias("pos", "key"))
    wanted = every.filter("pmod(key, 7) = 0").select("key").distinct()
    keys = {r[0] for r in wanted.collect()}
    passed = decontam._sift(every, wanted).collect()
    assert sorted(tuple(r) for r in passed) == sorted(tuple(r) for r in every.collect() if r["key"] in keys)
    want = result(spark, sf), near_result(spark, sf)
    monkeypatch.setattr(decontam, "maybe_broadcast", lambda df, *a: df)
    monkeypatch.setattr(decontam, "SIFT_BITS", 1 << 15)  # crowded: some words pass that are not wanted
    assert (result(spark, sf), near_result(spark, sf)) == want


def test_proximity(spark, write):
    docs = [(1, "the quick brown fox jumps"), (2, "fox the x x quick"), (3, "quick " + "x " * 30 + "fox the"),
            (4, "fox fox quick"), (5, None)]
    items = [(1, "the quick fox")]
    sf = write(documents=docs, benchmark=items)
    keyed = decontam.keyed(spark.read.parquet(f"{sf}/documents.parquet"))
    ph = decontam.phrases(spark.read.parquet(f"{sf}/benchmark.parquet"))
    got = decontam.proximity_matches(keyed, ph, within=4)
    assert {r["doc"]["id"] for r in got.collect()} == {1, 2}


def brute_near(spark, docs, items, within=10):
    """``(doc_id, item)`` of every window that a place has near one of its rarest words."""
    texts = [(d, words(t)) for d, t in docs]
    counts = Counter(w for _, t in texts for w in t)
    vocabulary = sorted(set(counts) | {w for _, t in items for w in words(t)})
    rows = spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w")).collect()
    code = {w: h for w, h in rows}
    out = set()
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            need = sorted(set(w[s:s + n]), key=lambda x: (counts[x], code[x]))
            lacking = 1 if len(need) >= 8 else 0
            known = [x for x in need if counts[x]]
            seen_from = known[:len(known) - len(need) + lacking + 1]
            if len(need) - len(known) <= lacking:
                out |= {(d, "null" if i is None else str(i)) for d, text in texts for p, x in enumerate(text)
                        if x in seen_from and len(set(need) & set(text[max(p - within, 0):p + within + 1]))
                        >= len(need) - lacking}
    return out


def near_tables(rng):
    """Items of 30 to 60 words, and texts that have them changed."""
    items = [(i, [rng.choice("the of and to in".split()) if rng.random() < 0.3 else f"w{rng.randrange(400)}"
                  for _ in range(30 + 6 * i)]) for i in range(6)]
    fill = [f"f{i}" for i in range(40)]
    docs = []
    for i, w in items:
        inserted = [x for p, x in enumerate(w) for x in ([x, "new"] if p % 6 == 5 else [x])]
        dropped = [x for p, x in enumerate(w) if p % 9 != 4]
        turned = [x for p in range(0, len(w), 4) for x in reversed(w[p:p + 4])]
        apart = [x for y in w for x in [y, *fill[:8]]]
        for k, v in enumerate([w, inserted, dropped, turned, apart, w[:5], w[:14] + fill + w[20:]]):
            docs.append((10 * i + k, " ".join(fill + v + fill)))
    return docs + [(900, None), (901, ""), (902, " ".join(fill))], [(i, " ".join(w)) for i, w in items]


def test_proximity_of_items_longer_than_the_span(spark, write):
    docs, items = near_tables(random.Random(5))
    # an item's word that no document has keeps the item's other windows
    items += [(50, items[3][1] + " unheard"), (51, "a short one")]
    docs += [(903, "one of the short x a"), (904, "a short")]
    sf = write(documents=docs, benchmark=items)
    ph = decontam.phrases(spark.read.parquet(f"{sf}/benchmark.parquet"))
    got = decontam.proximity_matches(decontam.keyed(spark.read.parquet(f"{sf}/documents.parquet")), ph)
    found = {(r["doc"]["id"], r["item"]) for r in got.join(ph, "pid").collect()}
    assert found == brute_near(spark, docs, items)
    for i in range(6):
        assert {(10 * i + k, str(i)) for k in (0, 1, 2, 3, 6)} <= found
        assert not {(10 * i + k, str(i)) for k in (4, 5)} & found
    assert {(30, "50"), (903, "51")} <= found and (904, "51") not in found


def near_result(spark, sf):
    rows = decontam.op10_positional_index(spark, sf).select("doc_id", "n_near_items", "near_items_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def near_rows(spark, docs, items):
    found = defaultdict(set)
    for n, i in brute_near(spark, [(n, t) for n, (_, t) in enumerate(docs)], items):
        found[n].add(i)
    return sorted(((d, len(found[n]), hashlib.sha256(",".join(sorted(found[n])).encode()).hexdigest())
                   for n, (d, _) in enumerate(docs)), key=repr)


def test_op10_near_items(spark, write, edges):
    docs, items = near_tables(random.Random(6))
    docs, items = docs + edges, items + [(60, "Kappa alpha"), (61, "one"), (None, "id no"), (62, ""), (63, None)]
    sf = write(documents=docs, benchmark=items)
    want = near_rows(spark, docs, items)
    assert near_result(spark, sf) == want
    assert result(spark, sf) == brute(docs, items)
    turned = next(r for r in result(spark, sf) if r[0] == 13)
    assert not turned[-1] and next(r for r in want if r[0] == 13)[1] > 0
    assert all(r[1] == 0 for r in near_result(spark, write(documents=docs, benchmark=[])))


def test_op10_near_items_given_tables(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert near_result(spark, SF) == near_rows(spark, pairs, items)
