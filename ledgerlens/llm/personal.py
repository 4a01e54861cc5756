"""Personal data by weak supervision: labelers vote, their reliabilities are
estimated, and a span classifier decides what else to report.

1. ``spans``: per text, the matches of each kind's fixed pattern with their
   places in code points.  A match that passes its check (``base``) is always
   reported.  Candidates beside them are matches that fail the check
   (``failed``) and matches of wider patterns (``wider``: spelt-out e-mail
   addresses, IPv6, national phone numbers) that touch no match of the kind's
   fixed pattern.
2. Every span gets a vote of 1, -1 or 0 (abstains) from each labeler:
   ``form`` and ``check`` (regular expressions and check digits), ``listed``
   (gazetteers: top-level domains, issuer prefixes, country codes, special
   networks), ``cue`` (words before it, for or against), ``alone`` (what
   stands next to it), ``shape`` (its parts) and ``dull`` (repeated digits).
3. ``estimate``: expectation-maximisation over the counts of vote patterns
   (at most ``3**7`` a kind, whatever the corpus): each labeler's chances of
   each vote on personal data and on other text, and so a posterior of each
   pattern.
4. ``fit``: a logistic regression a kind on the votes and the quotes around the
   span, trained on the posteriors.  Candidates that it gives ``THRESHOLD`` or
   more are reported beside the base spans.

All work on rows is column expressions; what reaches the driver are counts of
patterns.  Patterns are written so that matching takes linear time on long
texts: possessive repeats, and a run is only entered at its beginning.

Defined results: a null text is empty and has no spans; a null id stays null;
repeated rows get a row each; without any span nothing is trained; extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import let, materialize, table

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
ROUNDS = 25
CHUNK = 256
# The patterns of the four kinds.  ``(?<!..)`` and ``\G`` (the
# end of the match before) only keep a run from being entered in its middle,
# where it cannot match if it did not from its beginning.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"\x20?[(\[{][aA][tT][)\]}]\x20?", r"\x20?[(\[{][dD][oO][tT][)\]}]\x20?"
WIDER = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:@|{AT})[A-Za-z0-9-]++(?:(?:\.|{DOT})[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
}
# What a text must have for a pattern to match in it; cheaper than the pattern.
NEEDS = {
    ("email", "base"): "@", ("email", "wider"): r"[(\[{][aA][tT][)\]}]",
    ("ip", "base"): r"[0-9]\.[0-9]", ("ip", "wider"): r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]",
    ("card", "base"): r"[0-9](?:[\x20-]?[0-9]){11}",
    ("phone", "base"): r"\+[0-9]", ("phone", "wider"): r"[0-9]{3,4}[\x20.-][0-9]{4}",
}
# Gazetteers.
DOMAINS = r"(?i)(?:\.|[)\]}]\x20?)(?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|nl|eu|uk|us|ca|ch|at|be|jp|cn)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|6011|65)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SPECIAL_NETS = r"^(?:0+|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CUES = {
    "email": r"(?:e-?mail|mail|contact|kontakt|correo|courriel|write|schreib)\w*\W{0,4}$",
    "ip": r"(?:\bip|host|server|address|adresse|dirección|client|peer)\w*\W{0,4}$",
    "card": r"(?:card|visa|mastercard|carte|tarjeta|karte|credit|kredit)\w*\W{0,4}$",
    "phone": r"(?:phone|tel|call|fon|mobile|cell|handy|móvil|portable|fax)\w*\W{0,4}$",
}
AGAINST = r"(?:version|ver|build|order|invoice|isbn|token|key|hash|secret|section|page|rechnung|factura|facture)\W{0,4}$"
LABELERS = ("form", "check", "listed", "cue", "alone", "shape", "dull")
SPAN = "struct<kind int, begin int, stop int, form int, votes array<int>, quoted int>"


def running_sum(steps: Column) -> Column:
    """Inclusive running sums of an array, in chunks, so that a long array
    is not copied for each of its items."""
    def of_chunk(c: Column, sums: Column) -> Column:
        begin = F.aggregate(F.slice(sums, 1, c), F.lit(0), lambda a, x: a + x)
        grown = F.aggregate(F.slice(steps, c * CHUNK + 1, CHUNK), F.struct(begin.alias("at"), F.array().cast("array<int>")
                                                                          .alias("out")),
                            lambda a, x: F.struct((a["at"] + x).alias("at"),
                                                  F.concat(a["out"], F.array(a["at"] + x)).alias("out")))
        return grown["out"]

    chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))
    sums = F.transform(chunks, lambda c: F.aggregate(F.slice(steps, c * CHUNK + 1, CHUNK), F.lit(0), lambda a, x: a + x))
    return let(sums, lambda s: F.flatten(F.transform(chunks, lambda c: of_chunk(c, s))))


def matches(pattern: str, needs: str) -> Column:
    """``array<struct(begin, stop, hit, before, after)>`` of the leftmost
    non-overlapping matches in ``text``: places in code points, the match, and
    some of what stands before and after it."""
    def placed(hits: Column, between: Column) -> Column:
        n = F.size(hits)
        steps = F.zip_with(F.slice(between, 1, n), F.concat(F.array(F.lit("")), F.slice(hits, 1, n - 1)),
                           lambda gap, hit: F.char_length(gap) + F.char_length(hit))
        return let(steps, lambda s: let(running_sum(s), lambda begin: F.transform(hits, lambda hit, at: F.struct(
            F.get(begin, at).alias("begin"), (F.get(begin, at) + F.char_length(hit)).alias("stop"), hit.alias("hit"),
            F.right(F.get(between, at), F.lit(32)).alias("before"),
            F.left(F.get(between, at + 1), F.lit(8)).alias("after")))))

    none = F.array().cast("array<struct<begin int, stop int, hit string, before string, after string>>")
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    found = let(hits, lambda h: F.when(F.size(h) > 0, let(F.split("text", pattern, -1), lambda b: placed(h, b)))
                .otherwise(none))
    return F.when(F.col("text").rlike(needs), found).otherwise(none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    def counted(x: Column, at: Column) -> Column:
        twice = x.cast("int") * (at % 2 + 1)
        return twice - F.when(twice > 9, 9).otherwise(0)
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda x: x != ""), counted)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def small_parts(hit: Column) -> Column:
    """Whether all parts of a dotted number are 255 at most, leading zeros or not."""
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))


def passes(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's fixed pattern is personal data as it stands."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return small_parts(hit)
    if kind == "card":
        return let(digits(hit), lambda d: F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(False))
    return F.char_length(digits(hit)).between(9, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 where ``yes``, else -1 (where ``no``, if it is given), else 0."""
    if no is None:
        return F.when(yes, 1).otherwise(-1)
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, form: Column, m: Column) -> Column:
    """The labelers' votes on a match, in the order of ``LABELERS``."""
    hit = m["hit"]
    never = F.lit(False)
    six = hit.contains(":")
    check = {"email": _vote(hit.rlike(r"[A-Za-z]{2,}$")), "ip": _vote(six | small_parts(hit)),
             "card": let(digits(hit), lambda d: _vote(F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(False))),
             "phone": _vote(F.char_length(digits(hit)).between(9, 15))}[kind]
    listed = {"email": _vote(hit.rlike(DOMAINS)), "ip": _vote(never, ~six & hit.rlike(SPECIAL_NETS)),
              "card": _vote(digits(hit).rlike(ISSUERS)),
              "phone": _vote(hit.rlike(COUNTRIES), hit.startswith("+"))}[kind]
    before = F.lower(m["before"])
    alone = ((m["before"] == "") | m["before"].rlike(r"[\s\"'(<\[:,;|=]$")) & (
        (m["after"] == "") | m["after"].rlike(r"^[\s\"')>\],;:|!?.]"))
    shape = {"email": _vote(hit.rlike(r"^[^@(\[{]*[A-Za-z]")), "ip": _vote(six | ~hit.rlike(r"(?:^|\.)0[0-9]")),
             "card": _vote(hit.rlike(r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){3}$"), hit.rlike(r"[\x20-]")),
             "phone": _vote(hit.rlike(r"[\x20().-]"), never)}[kind]
    dull = _vote(never, hit.rlike(r"([0-9])(?:[^0-9]*\1){5}"))
    return F.array(*[v.cast("int") for v in (_vote(form == 0, form == 1), check, listed,
                                             _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)), _vote(alone),
                                             shape, dull)])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``, stored: every span of ``docs`` with its kind (place
    in ``KINDS``), form (0 base, 1 failed, 2 wider) and votes."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # stage by stage, so that each pattern runs once over a text
    texts = texts.withColumns({f"{k}_base": matches(BASE[k], NEEDS[k, "base"]) for k in KINDS})
    texts = texts.withColumns({f"{k}_wider": matches(WIDER[k], NEEDS[k, "wider"]) for k in WIDER})

    def rated(kind: str, form, m: Column) -> Column:
        return let(form, lambda f: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["begin"].alias("begin"), m["stop"].alias("stop"),
            f.alias("form"), votes(kind, f, m).alias("votes"),
            (m["before"].rlike("[\"']$") & m["after"].rlike("^[\"']")).cast("int").alias("quoted"))).cast(SPAN)

    def of_kind(kind: str) -> Column:
        base = F.col(f"{kind}_base")
        if kind == "card":       # short numbers are no candidates
            base = F.filter(base, lambda m: F.char_length(digits(m["hit"])) >= 12)
        some = F.transform(base, lambda m: rated(kind, F.when(passes(kind, m["hit"]), 0).otherwise(1), m))
        if kind not in WIDER:
            return some
        apart = F.filter(f"{kind}_wider", lambda w: ~F.exists(
            f"{kind}_base", lambda b: (b["begin"] < w["stop"]) & (w["begin"] < b["stop"])))
        return F.concat(some, F.transform(apart, lambda m: rated(kind, F.lit(2), m)))

    found = texts.select("doc_id", F.array_sort(F.concat(*map(of_kind, KINDS))).alias("spans"))
    return materialize(found, "spans")


@dataclass
class Model:
    """Of each kind: ``prior`` and ``chance[labeler][class][vote + 1]`` from
    the votes, ``weights`` of the span classifier."""
    prior: dict[int, float] = field(default_factory=dict)
    chance: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)


def posterior(votes: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    """Chance that each vote pattern (row) is of personal data."""
    logs = np.log(chance[np.arange(votes.shape[1]), :, votes + 1]).sum(axis=1) + np.log([1 - prior, prior])
    return 1 / (1 + np.exp(logs[:, 0] - logs[:, 1]))


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows) met ``n`` times.
    Starts from the majority; one made-up span of each vote keeps chances
    from nought."""
    p = np.clip(0.5 + 0.15 * votes.sum(axis=1), 0.05, 0.95)
    prior, chance = 0.5, np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        prior = float(np.clip((n * p).sum() / n.sum(), 0.01, 0.99))
        for v in range(3):
            hit = votes + 1 == v
            chance[:, 0, v] = (hit * (n * (1 - p))[:, None]).sum(axis=0) + 1
            chance[:, 1, v] = (hit * (n * p)[:, None]).sum(axis=0) + 1
        chance /= chance.sum(axis=2, keepdims=True)
        p = posterior(votes, prior, chance)
    return prior, chance


def features(votes: np.ndarray, quoted: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(votes)), votes == 1, votes == -1, quoted]).astype(float)


def fit(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = ROUNDS) -> np.ndarray:
    """Logistic regression on soft labels ``p`` by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (q - p)) + ridge * w
        curve = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def train(stored: DataFrame) -> Model:
    """Fits labelers and classifier to the counts of patterns of all spans."""
    patterns = (stored.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.quoted")
                .groupBy("kind", "votes", "quoted").agg(F.count(F.lit(1)).alias("n"))
                .orderBy("kind", "votes", "quoted").collect())   # at most 2 * 3**7 a kind
    model = Model()
    for kind in sorted({r["kind"] for r in patterns}):
        rows = [r for r in patterns if r["kind"] == kind]
        v, n = np.array([r["votes"] for r in rows]), np.array([float(r["n"]) for r in rows])
        model.prior[kind], model.chance[kind] = estimate(v, n)
        x = features(v, np.array([r["quoted"] for r in rows]))
        model.weights[kind] = fit(x, posterior(v, model.prior[kind], model.chance[kind]), n)
    return model


def score(span: Column, model: Model) -> Column:
    """The classifier's chance that a span is personal data."""
    out = F.lit(0.0)
    for kind, w in model.weights.items():
        half = len(LABELERS)
        total = F.lit(float(w[0])) + F.when(span["quoted"] == 1, float(w[-1])).otherwise(0.0)
        for at in range(half):
            vote = F.get(span["votes"], F.lit(at))
            total = total + F.when(vote == 1, float(w[1 + at])).when(vote == -1, float(w[1 + half + at])).otherwise(0.0)
        out = F.when(span["kind"] == kind, 1 / (1 + F.exp(-total))).otherwise(out)
    return out


def _joined(some: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["begin"].cast("string"),
                                                                s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``(doc_id, base, reported)``: per row of ``docs`` the base spans, and
    these with the candidates that the classifier takes, sorted by kind and
    place."""
    stored = spans(docs, id_col, text_col)
    model = train(stored)
    base = F.filter("spans", lambda s: s["form"] == 0)
    taken = F.filter("spans", lambda s: (s["form"] == 0) | (score(s, model) >= threshold))
    return stored.select("doc_id", base.alias("base"), taken.alias("reported"))


def op13_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    added = (F.size("reported") - F.size("base")).cast("long")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.col("reported")).alias("spans"), added.alias("n_added"))
