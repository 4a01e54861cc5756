import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import sharding, simple8b, tokens
from ledgerlens.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op1_columns_and_law(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op1_weighted_hash_tree(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    check_slots(rows)


def test_op1_edges(spark, write, edges):
    rows = sharding.op1_weighted_hash_tree(spark, write(documents=edges)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in edges)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {8}
    assert len({r["shard"] for r in rows if r["doc_id"] == 9}) == 1
    check_slots(rows)
    assert sharding.op1_weighted_hash_tree(spark, write(documents=[])).count() == 0


def test_movement_is_confined_to_what_changed(spark):
    base = sharding.build(24)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in base]
    df = spark.range(20000)
    df = sharding.assign(df, F.col("id"), base, "a")
    df = sharding.assign(df, F.col("id"), heavier, "b")
    df = sharding.assign(df, F.col("id"), sharding.grow(base), "c").cache()
    region, rack = {x.shard: x.region for x in base}, {x.shard: x.rack for x in base}
    for r in df.filter("a <> b").collect():  # rows move only into a subtree that got heavier
        assert region[r["b"]] == region[5] if region[r["a"]] != region[r["b"]] else (
            rack[r["b"]] == rack[5] if rack[r["a"]] != rack[r["b"]] else r["b"] == 5)
    assert {r["c"] for r in df.filter("a <> c").select("c").distinct().collect()} == {24}
    assert 650 < df.filter("c = 24").count() < 950
    counts = [r["count"] for r in df.groupBy("a").count().collect()]
    assert len(counts) == 24 and min(counts) > 700 and max(counts) < 970


def test_tree_weights(spark):
    tree = [sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(0, 1, 1, 2.0), sharding.Leaf(1, 2, 2, 3.0),
            sharding.Leaf(1, 2, 3, 0.0)]
    got = dict(sharding.assign(spark.range(30000), F.col("id"), tree).groupBy("shard").count().collect())
    assert set(got) == {0, 1, 2}
    assert abs(got[0] - 5000) < 400 and abs(got[1] - 10000) < 500 and abs(got[2] - 15000) < 500
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [sharding.Leaf(0, 0, 0, 0.0)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    data = simple8b.pack(v)
    assert (simple8b.unpack(data) == v).all()
    assert (simple8b.unpack(data, 1, 2) == v[1024:2048]).all()


def test_simple8b_packs_and_escapes():
    assert len(simple8b.pack(np.zeros(6000, np.uint64))) < 6000 / 60 * 8 + 300
    v = np.full(50, 2**64 - 1, dtype=np.uint64)
    words, escapes, _ = simple8b.encode(v)
    assert len(escapes) == 50 and (words >> np.uint64(60) == simple8b.ESCAPE).all()


def plain(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [e.ids + [2] for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_op4_against_plain_tokenization(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in tokens.op4_simple8b_tokens(spark, SF).collect()}
    start = 0
    for (i, _), ids in zip(docs, plain([t for _, t in docs])):
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)


def test_op4_edges(spark, write, edges):
    rows = tokens.op4_simple8b_tokens(spark, write(documents=edges)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in edges), key=lambda i: (i is not None, i))
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows[:-1]]))
    want = Counter((i, zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
                   for (i, _), ids in zip(edges, plain([t or "" for _, t in edges])))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == want
    assert tokens.op4_simple8b_tokens(spark, write(documents=[])).count() == 0


def test_op4_white_space_and_clashing_columns(spark):
    texts = ["a  b", " lead", "tail ", "x \n y", "tab\tand  nbsp  z", "it's <|endoftext|> here", "\n", "é è", "  "]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, tie int, row int")
    out = scratch_path(spark, "test")
    tokens.write_token_files(df, out, tokens.tokenizer_path())
    rows = tokens.read_token_files(spark, out).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [len(x) for x in plain(texts)]
    stream = [x for ids in plain(texts) for x in ids]
    part = tokens.read_range(spark, out, 5, 17).orderBy("position").collect()
    assert [r["id"] for r in part] == stream[5:17] and [r["position"] for r in part] == list(range(5, 17))
