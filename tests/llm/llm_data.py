"""Schemas and rows that the tests of the training-data operators share."""

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])
SCHEMAS = {
    "documents": DOC,
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def doc_rows(pairs):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]


# Nulls, empty and very long texts, ties, repeated rows.
EDGES = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, "   \n\t "),
         (5, "one"), (6, "one"), (7, "long " * 30000), (8, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"),
         (8, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (9, "naïve  double\n\nspace Ünïcode 😀 text"),
         (9, "the same id, another text"), (None, "no id at all"), (None, None), (10, "ONE"), (11, "a b")]
