"""Personal data: base spans against Python's patterns, labelers, EM and classifier."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import personal as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for at, c in enumerate(reversed(digits)):
        twice = int(c) * (1 + at % 2)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in hit.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base(text):
    return [(kind, m.start(), m.end()) for kind, rx in PATTERNS.items() for m in re.finditer(rx, text or "")
            if good(kind, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


def run(spark, tmp_path, rows, schema="doc_id long, text string"):
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(folder)
    return P.op13_weak_supervision_pii(spark, str(tmp_path)).collect()


def check(rows, got):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in got) == sorted(
        (i is None, i or 0, digest(joined(base(t)))) for i, t, *_ in rows)
    for r in got:
        texts = [t for i, t, *_ in rows if i == r.doc_id]
        own = [base(t) for t in texts]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] in [[sum(s[0] == k for s in b) for k in P.KINDS] for b in own]
        assert any(set(map(lambda s: joined([s]), b)) <= set(r.spans.split(",")) for b in own) or not any(own)


def random_text(rng):
    parts = ["a.b@c.de", "x@y", "@", ".", "..", "1.2.3.4", "256.1.1.1", "0000255.1.02.3", "4111111111111111",
             "4111-1111 1111-1111", "4111 1111 1111 1112", "+1 (407) 555-7710", "+12", "+", " ", "  ", "-", "(", ")", "_",
             "%", "é", "😀", "12", "7", "x", "\n", "(at)", " [dot] ", "1:2:3:4:5:6:7:8", "555 123 4567"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_base_spans_equal_those_of_plain_patterns(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, random_text(rng)) for i in range(600)]
    got = run(spark, tmp_path, rows)
    check(rows, got)
    assert any(r.n_added for r in got)
    for r in got:     # places are code points, spans of a kind apart and in order
        spans = [(k, int(a), int(e)) for k, a, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda s: (P.KINDS.index(s[0]), s[1]))
        for (k, _, e), (other, a, _) in zip(spans, spans[1:]):
            assert k != other or e <= a


def test_edges_long_texts_and_clashing_columns(spark, tmp_path, edges):
    rows = edges + [(20, "1" * 50000), (21, "a" * 3000 + "@"), (22, "1.2.3.4 " * 2000), (23, "+" * 3000 + "1 " * 3000),
                    (24, "a@b.c_d@e.f@g.h"), (25, "mail a.b@c.de, " * 700), (26, "1 " * 30000)]
    names = ["spans", "kind", "begin", "votes", "email_base", "base", "n_ip"]
    wide = [(*r, *["x"] * len(names)) for r in rows]
    schema = "doc_id long, text string" + "".join(f", {n} string" for n in names)
    check(rows, run(spark, tmp_path, wide, schema))


def test_empty_table_and_no_spans(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    (r,) = run(spark, tmp_path, [(1, "nothing here")])
    assert (r.n_email, r.spans, r.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_candidates_beside_the_base_are_judged(spark):
    rng = random.Random(2)
    rows = [(i, f"write to mail: j.doe{i}@mail{i % 9}.example.com or call {rng.randrange(200, 999)} 555 "
                f"{rng.randrange(1000, 9999)} today") for i in range(60)]
    rows += [(100 + i, f"contact jane{i} (at) example (dot) org now") for i in range(20)]
    rows += [(200 + i, f"version {rng.randrange(300, 999)}.{rng.randrange(300, 999)}.0{i}.1x") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.personal_data(docs).collect()}
    spelt = [got[100 + i].reported for i in range(20)]
    assert all(len(s) == 1 and s[0].kind == 0 and s[0].form == 2 for s in spelt)
    assert rows[60][1][spelt[0][0].begin:spelt[0][0].stop] == "jane0 (at) example (dot) org"
    assert not any(got[200 + i].reported for i in range(30))


def test_running_sums_across_chunks(spark):
    steps = list(range(1, 3 * P.CHUNK + 5))
    row = spark.createDataFrame([(steps,)], "steps array<int>").select(P.running_sum(F.col("steps")).alias("s")).first()
    assert row.s == list(np.cumsum(steps))


def test_em_finds_the_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.6])
    v = np.where(rng.random((20000, 5)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    v[rng.random(v.shape) < 0.2] = 0
    patterns, n = np.unique(v, axis=0, return_counts=True)
    prior, chance = P.estimate(patterns, n.astype(float), 60)
    assert abs(prior - 0.3) < 0.02
    voted = chance[:, 1, 2] / (chance[:, 1, 2] + chance[:, 1, 0])
    assert np.abs(voted - right).max() < 0.03
    p = P.posterior(patterns, prior, chance)
    w = P.fit(P.features(patterns, np.zeros(len(n))), p, n.astype(float))
    q = 1 / (1 + np.exp(-P.features(patterns, np.zeros(len(n))) @ w))
    assert (n * np.abs(p - q)).sum() / n.sum() < 0.02
