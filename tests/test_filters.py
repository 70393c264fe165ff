"""Filter semantics: nulls, contagion, lists and strings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilquery.functions.values import Fields, avg_of, count_of, max_of, min_of, now, sum_of, today, value

ROW = {"age": 25, "price": 30.0, "name": "Smith", "empty": "", "none": None, "children": ["joseph", "sarah"], "readings": [3, 5], "dob": dt.datetime(2000, 1, 1), "tall": True, "none_too": None}
KIND = "age int, price double, name string, empty string, none string, children array<string>, readings array<int>, dob timestamp, tall boolean, none_too string"


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([tuple(ROW.values())], KIND)


@pytest.mark.parametrize(
    ("test", "expected"),
    [
        (lambda f: f["age"] > 24, True), (lambda f: f["age"] > 25, False), (lambda f: (f["price"] > 24) & (f["age"] < 100), True),
        (lambda f: f["name"] == "Smith", True), (lambda f: f["name"] != "Smith", False), (lambda f: f["none"] == None, True),  # noqa: E711
        (lambda f: f["none"] == f["none_too"], True), (lambda f: f["none"] == "pepe", False), (lambda f: f["none"] != "pepe", True), (lambda f: f["none"] > "a", False),
        (lambda f: value("sarah").is_in(f["children"]), True), (lambda f: value("bob").is_in(f["children"]), False), (lambda f: value("mit").is_in(f["name"]), True),
        (lambda f: value(1).is_in([1, 2, 3]), True), (lambda f: ~f["children"].is_empty(), True), (lambda f: f["empty"].is_empty(), True), (lambda f: f["none"].is_empty(), True),
        (lambda f: f["name"].matches("S[a-z]+"), True), (lambda f: f["name"].matches("S[a-z]"), False), (lambda f: f["dob"] < dt.datetime(2001, 7, 4), True),
        (lambda f: value("abc\n").matches("abc"), False), (lambda f: value("abc\nx").matches("(?s)abc.x"), True), (lambda f: f["dob"] < today(), True), (lambda f: value(None) > now(), False),
        (lambda f: (now() >= today()) & (now() > f["dob"]), True), (lambda f: f["tall"], True), (lambda f: ~f["tall"], False), (lambda f: f["age"] & f["name"], True), (lambda f: f["empty"], False),
        (lambda f: value(5.9) + 1 == 6, True), (lambda f: value(7) / 2 == 3, True), (lambda f: value(-7) / 2 == -3, True), (lambda f: value(9).sqrt() == 3, True),
        (lambda f: f["name"].concat(None) == "Smithnull", True), (lambda f: f["name"].char_length() == 5, True), (lambda f: count_of(3, 5.5, 18) == 3, True),
        (lambda f: sum_of(f["readings"], 2) == 10, True), (lambda f: avg_of(f["readings"], 4) == 4, True), (lambda f: min_of(7, f["readings"]) == 3, True), (lambda f: max_of(f["readings"], 2) == 5, True),
    ],
)
def test_predicate(row, test, expected):
    assert row.select(test(Fields(row.schema)).truth().alias("x")).first()["x"] is expected


def test_types_are_checked(row):
    f = Fields(row.schema)
    for wrong in (lambda: f["name"] > 3, lambda: f["dob"] > "2001-07-04", lambda: f["name"] + 1, lambda: f["age"].is_empty()):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(KeyError):
        f["unknown"]


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = rows.where((Fields(rows.schema)["o_totalprice"] > 100000).truth()).select(F.col("o_orderkey"))._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" in plan.split("PushedFilters")[0] and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
