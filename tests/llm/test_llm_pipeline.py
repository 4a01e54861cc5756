"""The pipeline against a brute-force version, stage by stage."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from test_llm_decontam import brute
from test_llm_sharding_tokens import plain
from test_llm_simhash import brute_classes, brute_print

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402

from ledgerlens.llm import mixing, toxicity  # noqa: E402
from ledgerlens.llm.common import materialize, table  # noqa: E402

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def final_rows(copies):
    """What the token files hold, from (id, text) rows."""
    rows = sorted(copies, key=lambda r: r[0])
    out, start = [], 0
    for (i, _), ids in zip(rows, plain([t for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontaminate", "mix", "token_output"]

    clean = materialize(stages["toxicity"](spark, docs, SF), "t1")
    assert clean.columns == docs.columns
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, SF, "labels"))).collect()
    assert Counter(i for i, _ in pairs(clean)) == Counter(r["doc_id"] for r in scores if r["score"] < 0.7)

    single = materialize(stages["near_duplicates"](spark, clean, SF), "t2")
    assert single.columns == docs.columns
    least = brute_classes([(i, brute_print(t)) for i, t in pairs(clean)])
    assert sorted(i for i, _ in pairs(single)) == sorted(i for _, i in set(least.values()))

    kept = materialize(stages["decontaminate"](spark, single, SF), "t3")
    assert kept.columns == docs.columns
    judged = brute(pairs(single), [tuple(r) for r in table(spark, SF, "benchmark").collect()])
    assert sorted(i for i, _ in pairs(kept)) == sorted(r[0] for r in judged if not r[-1])
    assert any(r[-1] for r in judged)

    mixed = materialize(stages["mix"](spark, kept, SF), "t4")
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(kept, table(spark, SF, "labels")).collect()}
    assert Counter(i for i, _ in pairs(mixed)) == +Counter(copies)

    got = P.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == final_rows(pairs(mixed))


def test_pipeline_edges(spark, write, edges):
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 12)] + [(None, None, None)]
    sf = write(documents=edges, labels=labels, benchmark=[(1, "one"), (None, None)])
    assert P.run(spark, sf).count() >= 0
    assert P.run(spark, write(documents=[], labels=[], benchmark=[])).count() == 0


def test_planted_cases(spark, write):
    """Toxic, copied and leaked documents go; clean ones stay until the mix."""
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{rng.integers(10**6)}" for _ in range(n))
    docs = [(i, word(80) + (" vileword " if i < 60 else " ") + word(20)) for i in range(240)]
    labels = [(i, 1, int(i < 60)) for i in range(240)]
    leak = word(30)
    docs += [(300, docs[200][1]), (301, docs[200][1]), (302, word(40) + " " + leak.upper() + " " + word(9))]
    sf = write(documents=docs, labels=labels, benchmark=[(1, leak)])
    df = table(spark, sf, "documents")
    for name, stage in P.STAGES[:3]:
        df = materialize(stage(spark, df, sf), name)
    assert sorted(i for i, _ in pairs(df)) == list(range(60, 240))


@pytest.mark.parametrize("name", ["op1_weighted_hash_tree", "op10_positional_index", "pipeline"])
def test_registered(name):
    import __spark_entry__
    assert name in __spark_entry__.queries()
