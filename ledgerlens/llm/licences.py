"""Licence scans: canonical digest lookup.

A text is brought into a canonical form - lower case, without lines that state
a copyright, punctuation and white space as one separator, equivalent spellings
made one - and its SHA-256 is looked up among the digests of known licences by
a hash join.  The unit is the entire text: of the document, and of each of its
lines, so that a notice line in a longer document is found as well.

All of it is DataFrame functions.  The known texts are a fixed list, or a table
of (licence, text) whose digests are broadcast only after their size was
measured.

Defined results: a null text and a text that is empty in canonical form have a
null digest and match nothing; rows that repeat an id are each looked up; of two
licences with one canonical text the alphabetically first is given; further
columns are kept by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import doc_key, key_id, materialize, maybe_broadcast, table
from ledgerlens.llm.licence_texts import SPDX_NAMES, TEXTS, TITLES

# Spellings that licence matching takes as equal.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright holder", "copyright owner"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("licences", "licenses"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

# Known licence texts and notices, by SPDX name.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
KNOWN += TEXTS + [(name, f"SPDX-License-Identifier: {name}") for name in SPDX_NAMES]
# A full text also with its title over it.
KNOWN += [(name, f"{TITLES[name]}\n\n{text}") for name, text in KNOWN if name in TITLES and len(text) > 200]
# A line with a copyright statement (after lower case, behind
# comment marks if any), and what separates words.
COPYRIGHT_LINE = (r"(\n|^)[ \t#*/;%!-]*(copyright [0-9(©]|copyright ©|copyright [^\n]*(19|20)[0-9][0-9]|"
                  r"copyright the [^\n]*(authors|contributors|developers)|\(c\)|©|all rights reserved)[^\n]*")
SEPARATOR = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form.  Words are set two spaces apart while spellings are
    replaced, so that neighbours don't share a separator."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, SEPARATOR, "  ")), F.lit(" "))
    one = t
    for a, b in SPELLINGS:
        one = F.replace(one, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    # most texts have none of the spellings: one look saves the replacements, and changes nothing
    some = " (" + "|".join(sorted({a.split(" ")[0] for a, _ in SPELLINGS})) + ") "
    return F.trim(F.replace(F.when(t.rlike(some), one).otherwise(t), F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]"), F.sha2(canonical(text), 256))


def known_digests(known: DataFrame) -> DataFrame:
    """``(digest, licence)`` of a table ``(licence, text)``."""
    return (known.select(digest(F.col("text")).alias("known_digest"), "licence").filter("known_digest is not null")
            .groupBy("known_digest").agg(F.min("licence").alias("licence")))


def builtin(spark: SparkSession) -> DataFrame:
    """The fixed list as a local relation."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("text")) for n, t in KNOWN]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


def scan(df: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``digest`` and ``license`` (null if unknown) of each entire
    text; nothing but the known digests moves.  Columns of ``df`` of these two
    names give way to them, all others stay."""
    marked = df.withColumn("digest", digest(F.col(text_col))).drop("license")
    found = maybe_broadcast(known_digests(known).select("known_digest", F.col("licence").alias("__found")))
    joined = marked.join(found, marked["digest"] == found["known_digest"], "left").drop("known_digest")
    return joined.withColumnRenamed("__found", "license")


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"[\p{L}\p{N}]+", 0)


def possible_first_words(known: DataFrame) -> DataFrame:
    """``(first)``: the words that a text may begin with if its canonical form
    is known.  A form begins with the text's first word, or with what a
    spelling that begins with that word is replaced by; where a copyright line
    is left out, nothing of a line remains."""
    begins = known.select(F.split(canonical(F.col("text")), " ")[0].alias("first"))
    spelt = sorted({a.split(" ")[0] for a, _ in SPELLINGS})
    more = known.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, spelt))).alias("first"))
    return begins.unionByName(more).distinct()


def scan_lines(df: DataFrame, known: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` with ``line_licenses`` (names in order, comma-joined) and
    ``n_license_lines`` (different lines of the text) of the rows that have a
    line that is a known text.  Lines whose first word no known text can begin
    with are not brought into canonical form, and lines that match nothing are
    dropped before the shuffle."""
    line = F.posexplode(F.split(F.col(text_col), "\n"))
    lines = df.select(*keys, line.alias("__line_no", "__line")).withColumn("__first", first_word(F.col("__line")))
    words = materialize(possible_first_words(known), "first-words")
    lines = lines.join(maybe_broadcast(words.withColumnRenamed("first", "__first")), "__first", "left_semi")
    hits = scan(lines, known, "__line").filter("license is not null")
    return hits.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"),
        F.size(F.collect_set("__line_no")).cast("long").alias("n_license_lines"))


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = doc_key(F.col("doc_id"), F.xxhash64("text")).alias("doc")
    docs = table(spark, sf_dir, "documents").select(key, "text")
    known = builtin(spark)
    whole = scan(docs, known).select("doc", "digest", "license")
    lines = scan_lines(docs, known, ["doc"])
    return (whole.join(lines, "doc", "left")
            .select(key_id("doc").alias("doc_id"), "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
                    F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines")))


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _sql_canonical(column: str) -> str:
    t = f"regexp_replace(lower({column}), '{COPYRIGHT_LINE}', '', 'g')"
    t = f"' ' || trim(regexp_replace({t}, '{SEPARATOR}', '  ', 'g')) || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(replace({t}, '  ', ' '))"


def _sql_digest(column: str) -> str:
    return (f"CASE WHEN regexp_replace(coalesce({column}, ''), '{SEPARATOR}', '', 'g') <> '' "
            f"THEN sha256({_sql_canonical(column)}) END")


def oracle() -> str:
    values = ", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in KNOWN)
    return f"""
WITH known AS (
  SELECT {_sql_digest('text')} AS known_digest, min(licence) AS licence
  FROM (VALUES {values}) v(licence, text) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents),
whole AS (SELECT row_no, doc_id, {_sql_digest('text')} AS digest FROM docs),
pieces AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (
  SELECT row_no, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licenses, count(*) AS n
  FROM (SELECT row_no, {_sql_digest('line')} AS d FROM pieces WHERE trim(line) <> '') p
  JOIN known ON d = known_digest GROUP BY row_no)
SELECT doc_id, digest, licence AS license, coalesce(line_licenses, '') AS line_licenses,
       coalesce(n, 0)::BIGINT AS n_license_lines
FROM whole LEFT JOIN known ON digest = known_digest LEFT JOIN lines USING (row_no)"""
