"""Every registered query equals its DuckDB oracle SQL (sf0.001, bit-exact)."""

import pytest

from testdata_paths import SF_SMALL
from ledgerlens.oracle.compare import compare, oracle_connection
from ledgerlens.oracle.sql import oracle_queries
from ledgerlens.registry import queries

QUERIES = queries()
SQLS = oracle_queries()
KEYS = [k for k in QUERIES if k in SQLS]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_SMALL)


def test_every_query_but_json_pack_has_oracle():
    assert set(QUERIES) - set(SQLS) == {"fact_pack"}
    assert set(SQLS) <= set(QUERIES)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    r = compare(QUERIES[key](spark, SF_SMALL), con, SQLS[key])
    assert r["columns"], (r["spark_cols"], r["oracle_cols"])
    assert r["rows"], (r["n_spark"], r["n_oracle"])
    assert r["exact"], key


def test_fact_pack_rows(spark, wh):
    from ledgerlens.plans.facts import TOPICS, fact_pack
    pack = fact_pack(wh)
    keys = {r["fact_key"] for r in pack.select("fact_key").distinct().collect()}
    assert keys == {k for ks in TOPICS.values() for k in ks}
    assert pack.filter("row_json IS NULL").count() == 0


def test_schemas_match_oracle(spark, con):
    from pyspark.sql import types as T
    names = {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
             T.DateType: "DATE", T.BooleanType: "BOOLEAN"}
    bad = {}
    for key in KEYS:
        s = {f.name: names.get(type(f.dataType), str(f.dataType)) for f in QUERIES[key](spark, SF_SMALL).schema}
        d = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({SQLS[key]})").fetchall()}
        if s != d:
            bad[key] = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
    assert not bad, bad
