import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.bucket import bucket100, raw_bucket
from ledgerlens.functions.calendar import prior_year_month
from ledgerlens.functions.filters import Filter, parse_list, period


def _py_bucket(*vals):
    return int(hashlib.md5("|".join(vals).encode()).hexdigest()[:8], 16)


def test_bucket_matches_md5(spark):
    rows = [("1000", "O1", 1995), ("2100", "L7-3", 2001), ("5000", "R12-1", 1999)]
    df = spark.createDataFrame(rows, "c string, d string, y int")
    got = df.select(raw_bucket("c", "d", "y").alias("r"), bucket100("c", "d", "y", F.lit("ap")).alias("b")).collect()
    for (c, d, y), g in zip(rows, got):
        assert g["r"] == _py_bucket(c, d, str(y))
        assert g["b"] == _py_bucket(c, d, str(y), "ap") % 100


def test_period_rules():
    assert period("2001-03", "2000-11", "2000-08", "2001-07") == ("2000-11", "2001-03")   # reversed -> swapped
    assert period("2000-13", "2001-02", "2000-08", "2001-07") == ("2000-08", "2001-02")   # malformed -> default
    assert period(None, "", "2000-08", "2001-07") == ("2000-08", "2001-07")
    assert parse_list(" a, ,b ") == ["a", "b"]
    assert parse_list("") == []
    assert prior_year_month("2001-07") == "2000-07"


@pytest.mark.parametrize("companies,expected", [("", 3), ("US Operations", 1), ("US Operations,EU Operations", 2)])
def test_company_filter(spark, companies, expected):
    f = Filter.build(companies, None, None, default_from="2000-08", default_to="2001-07")
    df = spark.createDataFrame([("US Operations",), ("EU Operations",), ("Japan Operations",)], "company string")
    assert df.filter(f.company_pred()).count() == expected
