"""Fingerprints, licences, HTML and chat against brute force."""

import hashlib
import html
import itertools
import math
import random
import re
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import chat, html_tree, licences, order_minhash
from ledgerlens.llm.common import table

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


# --- Order MinHash ---------------------------------------------------------

def hash_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v & MASK), seed)
    return seed


def hash_int(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", value), seed)


def brute_signature(text):
    """Order MinHash with lists and dictionaries."""
    m = order_minhash
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t\n\x0B\f\r]+", text or "") if w]
    k = [hash_longs(h[i:i + m.K]) for i in range(len(h) - m.K + 1)] if len(h) >= m.K else [hash_longs(h)] if h else []
    seen, bins = {}, {}
    for place, g in enumerate(k):
        kind = g & ~m.POS_MASK & MASK
        n = seen[kind] = seen.get(kind, -1) + 1
        x = hash_int(n, hash_longs([kind]))
        bins.setdefault(x >> (64 - m.BIN_BITS), []).append(
            ((x >> (64 - m.BIN_BITS - m.RANK_BITS)) & ((1 << m.RANK_BITS) - 1), place))
    out = {}
    for b, members in bins.items():
        acc = hash_longs([b])
        for place in sorted(p for _, p in sorted(members)[:m.PICK]):
            acc = hash_longs([acc, k[place]])
        out[b] = acc & 0xFFFFFFFF
    return out


def brute_likeness(a, b):
    bins = set(a) | set(b)
    return sum(a.get(x) == b.get(x) for x in bins) / len(bins) if bins else 1.0


def brute_op3(docs):
    """docs in ascending order; -> {(id, text): row}"""
    out = {}
    for i, (d, t) in enumerate(docs):
        nxt = docs[i - 1][1] or ""
        t = t or ""
        cut = len(t) // 3
        edited = t[:len(t) - cut] + nxt[:cut]
        own, ed = brute_signature(t), brute_signature(edited)
        name = lambda s: "".join(f"{b:02x}{v:08x}" for b, v in sorted(s.items()))
        out[d, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), name(own), name(ed),
                     brute_likeness(own, ed), brute_likeness(own, brute_signature(nxt)))
    return out


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_op3_against_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect())
    want = {d: v for (d, _), v in brute_op3(docs).items()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in order_minhash.op3_order_minhash(spark, SF).collect()}
    assert got == want


def test_op3_edges(spark, write, edges):
    distinct = [e for e in dict.fromkeys(edges) if e[0] not in (9, None)]  # ids that are not shared
    repeats = "x y " * 50 + "z " + "x y x " * 20
    docs = distinct + [(20, repeats), (21, repeats + " end"), (22, "x y x y x y")]
    got = order_minhash.op3_order_minhash(spark, write(documents=docs + [(8, dict(docs)[8])])).collect()
    want = {d: v for (d, _), v in brute_op3(sorted(docs)).items()}
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert sum(r["doc_id"] == 8 for r in got) == 2
    everything = order_minhash.op3_order_minhash(spark, write(documents=edges)).collect()
    assert len(everything) == len(edges)
    single = order_minhash.op3_order_minhash(spark, write(documents=[(1, "a b c d e f")])).collect()
    assert single[0]["near_next"] == 1.0
    assert order_minhash.op3_order_minhash(spark, write(documents=[])).count() == 0


def test_order_of_passages_matters(spark):
    rng = random.Random(2)
    w = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    swapped = w[300:] + w[:300]
    df = spark.createDataFrame([(" ".join(w), " ".join(swapped), " ".join(w[:590] + ["new"]))], "a string, b string, c string")
    for c in "abc":
        df = order_minhash.with_signature(df, c, f"s_{c}")
    r = df.select(order_minhash.likeness(F.col("s_a"), F.col("s_b")).alias("moved"),
                  order_minhash.likeness(F.col("s_a"), F.col("s_c")).alias("edited")).first()
    assert r["edited"] > 0.85 and r["moved"] < 0.75  # all but one k-mer are shared in both


# --- licences --------------------------------------------------------------

def test_op7_equals_sql(spark, write, edges):
    mit = next(t for n, t in licences.KNOWN if n == "MIT" and len(t) > 200)
    docs = edges + [(50, mit), (51, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence")),
                    (52, "text\nReleased under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0."),
                    (52, "text\nReleased under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0."),
                    (53, "prefix " + mit), (54, "© 2001 x"), (None, "Released under the MIT License.")]
    sf = write(documents=docs)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    got = licences.op7_license_digests(spark, sf)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == sorted(con.sql(licences.oracle()).fetchall(), key=repr)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[50]["license"] == by[51]["license"] == "MIT" and by[53]["license"] is None
    assert by[52]["line_licenses"] == "CC-BY-NC-4.0,MIT" and by[52]["n_license_lines"] == 2
    assert by[None] is not None and by[54]["digest"] is not None and by[2]["digest"] is None


def test_usual_licence_files_are_found(spark):
    """With title, comment marks and each form of copyright line; clashing columns."""
    text = {n: t for n, t in licences.KNOWN if len(t) > 200 and not t.startswith(licences.TITLES.get(n, "?"))}
    mit = text["MIT"]
    marked = "\n".join("# " + x for x in ("Copyright 2020 Some One\n" + mit).split("\n"))
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit), ("MIT", marked),
            ("MIT", marked.replace("# ", " * ")), ("MIT", "Copyright The Thing Authors\n" + mit),
            ("MIT", "Copyright Some One 2020\nAll rights reserved.\n" + mit),
            ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, X\n\n" + text["BSD-3-Clause"]),
            ("GPL-3.0-or-later", "// " + text["GPL-3.0-or-later"].replace("\n", "\n// ")),
            ("MPL-2.0", "/* " + dict(licences.TEXTS)["MPL-2.0"] + " */"), ("Zlib", text["Zlib"]), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
            (None, mit + " and more"), (None, "Copyright holders of the world"), (None, None), (None, "")]
    df = spark.createDataFrame([(i, *r, "x", "y", "z") for i, r in enumerate(rows)],
                               "id int, expected string, text string, licence string, digest string, license string")
    got = licences.scan(df, licences.builtin(spark)).collect()
    assert [r["license"] for r in sorted(got)] == [e for e, _ in rows] and {r["licence"] for r in got} == {"x"}


def test_lines_are_passed_over_by_their_first_word_alone(spark):
    known = spark.createDataFrame([("A", "Licence per cent"), ("B", "noncommercial use"), ("C", "Wilful one")],
                                  "licence string, text string")
    lines = ["LICENSE: percent", "non-commercial use", "Non Commercial, use!", "# willful one", "licence per cent", "other",
             "the noncommercial use", "", "Copyright 2020 licence per cent", "İ wilful one"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(99, "\n".join(lines))], "id int, text string")
    got = {r["id"]: (r["line_licenses"], r["n_license_lines"]) for r in licences.scan_lines(df, known, ["id"]).collect()}
    assert got == {0: ("A", 1), 1: ("B", 1), 2: ("B", 1), 3: ("C", 1), 4: ("A", 1), 99: ("A,B,C", 5)}


def test_scan_keeps_columns_and_takes_a_table_of_licences(spark):
    known = spark.createDataFrame([("B", "Some favour"), ("A", "some FAVOR."), ("C", None)], "licence string, text string")
    df = spark.createDataFrame([(1, "Some  favor", "x"), (2, None, "y")], "id long, text string, known string")
    got = licences.scan(df, known).collect()
    assert {(r["id"], r["known"], r["license"]) for r in got} == {(1, "x", "A"), (2, "y", None)}


# --- HTML ------------------------------------------------------------------

def brute_marginals(page, f):
    total, on = 0.0, [0.0] * len(page.nodes)
    for labels in itertools.product((0, 1), repeat=len(page.nodes)):
        w = -30.0 * labels[0]
        for node, y in zip(page.nodes[1:], labels[1:]):
            p = page.nodes[node.parent]
            w += f.edge[p.group, node.group, labels[node.parent], y] + y * f.odds.get(html_tree.look(node), 0.0)
        w = math.exp(w)
        total += w
        for i, y in enumerate(labels):
            on[i] += w * y
    return [x / total for x in on]


PAGE = """<html><body><div><p>some words here, enough of them</p><ul><li><a href=x>link</a></ul></div>
<article>text<p>more<aside>no</aside></article></body>"""


@pytest.fixture(scope="module")
def factors(spark):
    return html_tree.train(table(spark, SF, "pages"))


def test_marginals_are_exact(factors):
    page = html_tree.parse(PAGE)
    assert html_tree.marginals(page, factors) == pytest.approx(brute_marginals(page, factors), abs=1e-9)


def expected_text(source):
    """The article's text on the given pages, by their one template."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_op5_on_all_given_pages(spark):
    pages = {r["page_id"]: r for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    rows = html_tree.op5_dom_sum_product(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == expected_text(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


@pytest.mark.parametrize("source, text", [
    ("<nav><a>Home</a></nav><main><h1>T &amp; U</h1><p>One&nbsp;two\n three</p><div class='ad'>Buy</div></main>", "T & U\nOne two three"),
    ("<article><p>a<p>b <b>c</b>d<script>x<y</script><!-- no --> e</article><footer>f</footer>", "a\nb cd e"),
    ("<article><p>kept</p><section id='comments'><p>I liked it so very much that I write this long comment here.</p>"
     "</section><form><label>Mail</label><p>Leave a mail please.</p></form></article>", "kept"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><pre>p  q</pre></article>", "one\ntwo\nx\ny\np q"),
    ("<div class='post-content'><p>Said &lt;b&gt; &#233; &copy 1 &am</p></div><aside>no</aside>", "Said <b> é © 1 &am"),
    ("<article><p>cut <b>off", "cut off"),
    ("<div style='display:none'>hidden</div>", ""), ("", ""), (None, ""), ("<<<>>", ""), ("</p></div>", ""),
])
def test_main_text(factors, source, text):
    assert html_tree.main_text(source, factors) == text


PROSE = "A sentence of ordinary prose that goes on for a while, with commas, and ends at last."


@pytest.mark.parametrize("inner, text", [
    ("<p>one<p><svg>two<p>three", "one\ntwo\nthree"),
    ("<p>one</p><audio src=a><p>two</p><video><p>three</p><video>none</video>", "one\ntwo\nthree"),
    ("<p>a<audio>no sound</audio>b</p><textarea>one <p>two</p>", "ab\ntwo"),
    ("<p>Energy is <math><mi>E</mi>=<mi>m</mi></math> here</p>", "Energy is E=m here"),
    (f"<section class='related-work'><p>{PROSE}</p></section>", PROSE),
    ("<p>kept</p><section class='related-posts'><p>See also this one.</p></section>", "kept"),
    ("<p>kept</p><div class='related'><p>See also this one.</p></div>", "kept"),
    (f"<div class='story-widget text'><p>{PROSE}</p></div>", PROSE),
    ("<p>kept</p><div class='widget'><p>Weather today.</p></div>", "kept"),
    (f"<p>{PROSE}</p><address>1 Long Street</address>", PROSE + "\n1 Long Street"),
    ("<p>Read <span class='advert'>Buy now</span> on.</p><p>And <span class='share'>Tell all</span>on</p>",
     "Read on.\nAnd on"),
    ("<p>Read <span class='advert'>Buy <b>now", "Read"),
    ("<p>so <span hidden>no</span><span class='name'>yes</span></p>", "so yes"),
    ("<p>a<img alt=\"5\" tall\">b</p><p title='x > y'>c</p><img alt=\"un>closed", "ab\nc\nclosed"),
])
def test_nothing_but_chrome_is_lost(factors, inner, text):
    assert html_tree.main_text(f"<body><article>{inner}</article></body>", factors) == text


def test_pages_of_several_templates(factors):
    body = [f"{PROSE} Number {i}." for i in range(4)]
    menu = "".join(f"<li><a href=/{i}>Topic {i}</a>" for i in range(6))
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    pages = [
        f"<header><ul>{menu}</ul></header><main>{paragraphs}</main><footer>About us</footer>",
        f"<div id=topNav><ul>{menu}</ul></div><div class='entry-content'>{paragraphs}</div><div class=sidebar>{menu}</div>",
        f"<table><tr><td class=menu>{menu}<td class=articleBody>{paragraphs}</table><div class='cookie-notice'>Ok?</div>",
        f"<article>{paragraphs}<div class='comments'><p>{PROSE}</p></div></article><aside>{menu}</aside>",
        f"<div><ul>{menu}</ul></div><div>{paragraphs}</div>",
    ]
    for page in pages:
        assert html_tree.main_text(f"<html><body>{page}</body></html>", factors).split("\n") == body


def test_op5_further_columns(spark, write):
    folder = write(pages=[(1, "u", "<article><p>one</p></article>")])
    pages = (spark.read.parquet(f"{folder}/pages.parquet").withColumn("text", F.lit("x")).withColumn("id", F.lit(9))
             .withColumn("chosen", F.lit(1)).withColumn("n_chars", F.lit(0)))
    got = html_tree.extract(pages, html_tree.train(pages)).collect()
    assert [tuple(r) for r in got] == [(1, "u", "one", 3)]


def test_unmarked_page_is_decided_by_its_text(factors):
    long = "A sentence of ordinary prose that goes on for a while, with commas, and ends at last. " * 4
    source = (f"<body><div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div><h2>Title</h2><p>{long}</p>"
              f"<p>Short one.</p><p>{long}</p></div></body>")
    assert html_tree.main_text(source, factors).split("\n") == ["Title", long.strip(), "Short one.", long.strip()]


def test_op5_edges(spark, write):
    rows = [(1, "u", PAGE), (1, None, PAGE), (2, "v", None), (None, "w", ""), (3, "x", "<article>" + "<div>" * 3000 + "deep"),
            (4, "y", "<article><p>" + "long text " * 50000)]
    got = html_tree.op5_dom_sum_product(spark, write(pages=rows)).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in got}
    assert by[2, "v"]["text"] == by[None, "w"]["text"] == "" and by[3, "x"]["text"] == "deep"
    assert by[4, "y"]["n_chars"] == 499999 and by[1, "u"]["text"] == by[1, None]["text"]
    assert html_tree.op5_dom_sum_product(spark, write(pages=[])).count() == 0


# --- chat ------------------------------------------------------------------

def brute_cost(codes):
    """Cheapest repair by trying every label of every turn."""
    best = None
    for labels in itertools.product(range(3), repeat=len(codes)):
        cost, state = 0, chat.START
        for given, role in zip(codes, labels):
            step = chat.step(state, role)
            if step is None:
                break
            cost += step[0] + (0 if given == role else chat.COSTS["relabel"])
            state = role
        else:
            cost += int(chat.END[state])
            best = cost if best is None else min(best, cost)
    return best


def is_legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and bool(body)


def check_conversations(rows, given):
    """Each conversation is legal, costs the least and keeps every turn."""
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    assert set(by) == {c for c, *_ in given}
    for conv, lines in by.items():
        lines.sort(key=lambda r: (r["message"], r["part"]))
        assert lines[-1]["action"] == "end"
        heads = {r["message"]: r["role"] for r in lines}
        assert sorted(heads) == list(range(len(heads)))
        assert is_legal([heads[m] for m in sorted(heads)])
        turns = [r for r in lines if r["action"] not in ("insert", "end")]
        key = lambda t: (t[1] is None, t[1] or 0, t[2] or "")
        mine = sorted((t for t in given if t[0] == conv), key=key)
        assert [r["turn"] for r in turns] == [t[1] for t in mine]
        assert sorted(r["text"] for r in turns) == sorted(t[3] or "" for t in mine)
        cost = (sum(chat.COSTS["relabel"] for r in turns if r["action"].startswith("relabel"))
                + sum(chat.COSTS["merge"] for r in turns if r["action"].endswith("merge"))
                + sum(chat.COSTS["insert"] for r in lines if r["action"] == "insert"))
        assert {r["conv_cost"] for r in lines} == {cost}
        codes = [chat.ALIASES.get((t[2] or "").strip().lower(), chat.UNKNOWN) for t in mine]
        if len(codes) <= 7:
            assert cost == brute_cost(codes)
        rendered = "".join(r["piece"] for r in lines)
        messages = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", rendered, re.S)
        assert [m[0] for m in messages] == [heads[m] for m in sorted(heads)]
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in messages) == rendered


def odd_conversations():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "human", "GPT ", "tool", None, ""]
    out = [(c, t, rng.choice(roles), f"c{c}t{t}") for c in range(60) for t in range(rng.randrange(1, 8))]
    out += [(None, 0, "user", "x"), (None, None, "assistant", None), (70, 1, "user", "a"), (70, 1, "user", "a"),
            (71, None, "system", ""), (72, 5, "user", "later"), (72, 2, "user", "first")]
    return out


def test_op6_edges_against_brute_force(spark, write):
    given = odd_conversations()
    rows = chat.op6_role_repair(spark, write(conversations=given)).collect()
    check_conversations(rows, given)
    assert chat.op6_role_repair(spark, write(conversations=[])).count() == 0


def test_op6_segments_do_not_change_the_repair(spark, write, monkeypatch):
    rng = random.Random(9)
    given = [(1, t, rng.choice(["user", "assistant", "system", "?"]), f"t{t}") for t in range(60)] + odd_conversations()[:40]
    given = [(c + 10 if c != 1 or t >= 60 else 1, t, r, x) for c, t, r, x in given]
    whole = chat.op6_role_repair(spark, write(conversations=given)).collect()
    monkeypatch.setattr(chat, "SEGMENT", 4)
    cut = chat.op6_role_repair(spark, write(conversations=given)).collect()
    check_conversations(cut, given)
    strip = lambda rows: sorted((repr(r["conv_id"]), r["message"], r["role"], r["action"], repr(r["turn"]), r["piece"],
                                 r["conv_cost"]) for r in rows)
    assert sum(r[-1] for r in strip(whole)) == sum(r[-1] for r in strip(cut))


def test_op6_given_conversations(spark):
    given = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    check_conversations(chat.op6_role_repair(spark, SF).collect(), given)


def test_a_text_with_more_places_than_fit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "POS_MASK", 7)
    df = spark.createDataFrame([(" ".join("abcdefghi"),), (" ".join("abcdefghij"),)], "text string")
    assert order_minhash.with_signature(df.limit(1), "text", "sig").first()["sig"]
    with pytest.raises(Exception, match="more than 8 k-mers"):
        order_minhash.with_signature(df, "text", "sig").collect()
