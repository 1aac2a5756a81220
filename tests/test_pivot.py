"""Pivot fixtures (FIXTURES.md section 2)."""

import pytest

from colscope.operators.pivot import PivotError, pivot_long, pivot_report, pivot_table

ROWS = [("x", "p", 1.0, "k"), ("x", "q", 2.0, "l"), ("y", "p", None, "l"), (None, "q", 4.0, None)]
SCHEMA = "a string, b string, v double, t string"


def as_dict(df, key="a"):
    return {r[key]: {k: r[k] for k in df.columns if k != key} for r in df.collect()}


def test_blank_key_mean_drops_all_null_group(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = pivot_table(df, ["a"], ["b"], "v", "mean")
    assert as_dict(got) == {"(En blanco)": {"p": 0.0, "q": 4.0}, "x": {"p": 1.0, "q": 2.0}}
    assert [r["a"] for r in got.collect()] == ["(En blanco)", "x"]


def test_blank_key_sum_keeps_group(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = as_dict(pivot_table(df, ["a"], ["b"], "v", "sum"))
    assert got["y"] == {"p": 0.0, "q": 0.0}
    assert got["(En blanco)"] == {"p": 0.0, "q": 4.0}


def test_count_is_distinct_count(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = as_dict(pivot_table(df, ["a"], ["b"], "t", "count"))
    assert got == {"(En blanco)": {"p": 0, "q": 0}, "x": {"p": 1, "q": 1}, "y": {"p": 1, "q": 0}}


def test_headers_of_two_column_keys(spark):
    df = spark.createDataFrame([("r", "p", 1, 1.0), ("r", "q", 2, 2.0)], "a string, b string, c int, v double")
    got = pivot_table(df, ["a"], ["b", "c"], "v", "sum")
    assert got.columns == ["a", "p - 1", "q - 2"]


def test_text_max_fills_empty_string(spark):
    df = spark.createDataFrame([("r1", "p", "zz"), ("r2", "q", "aa")], "a string, b string, t string")
    got = as_dict(pivot_table(df, ["a"], ["b"], "t", "max"))
    assert got == {"r1": {"p": "zz", "q": ""}, "r2": {"p": "", "q": "aa"}}


def test_rows_only(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = pivot_table(df, ["a", "b"], [], "v", "median")
    assert [(r["a"], r["b"], r["v"]) for r in got.collect()] == [
        ("(En blanco)", "q", 4.0), ("x", "p", 1.0), ("x", "q", 2.0)]


def test_numeric_key_with_nulls_sorts_numbers_first(spark):
    df = spark.createDataFrame([(2, 1.0), (None, 2.0), (1, 3.0)], "k int, v double")
    got = pivot_table(df, ["k"], [], "v", "sum")
    assert [r["k"] for r in got.collect()] == ["1", "2", "(En blanco)"]


@pytest.mark.parametrize("rows,cols,value,fn", [
    ([], ["b"], "v", "sum"),            # V1 no row key
    (["a"], ["b"], "v", "avg"),         # V2 bad function
    (["a"], ["zz"], "v", "sum"),        # V4 missing column
    (["a"], ["b"], "t", "sum"),         # V5 sum of text
    (["a"], ["a"], "v", "sum"),         # V6 shared key
    (["a"], ["b"], "a", "count"),       # V7 value used as key
])
def test_rules(spark, rows, cols, value, fn):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(PivotError):
        pivot_table(df, rows, cols, value, fn)


def test_duplicate_columns_rule(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "a int, b int, v double").toDF("a", "a", "v")
    with pytest.raises(PivotError):
        pivot_table(df, ["a"], [], "v", "sum")


def test_empty_result(spark):
    df = spark.createDataFrame([("x", None)], "a string, v double")
    with pytest.raises(PivotError):
        pivot_report(df, ["a"], [], "v", "mean")


def test_equal_headers_are_refused(spark):
    df = spark.createDataFrame([("r", "a - b", "c", 1.0), ("r", "a", "b - c", 2.0)], "k string, x string, y string, v double")
    with pytest.raises(PivotError):
        pivot_table(df, ["k"], ["x", "y"], "v", "sum")
    assert {(r.header, r.value) for r in pivot_long(df, ["k"], ["x", "y"], "v", "sum").collect()} == {("a - b - c", 1.0), ("a - b - c", 2.0)}


def test_nan_is_no_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([("r", 1.0), ("r", nan), ("r", 5.0), (None, 2.0), ("(En blanco)", 3.0)], "k string, v double")
    for function, want in (("max", 5.0), ("median", 3.0), ("count", 2), ("min", 1.0)):
        assert {r.k: r.v for r in pivot_table(df, ["k"], [], "v", function).collect()}["r"] == want
    assert {r.k: r.v for r in pivot_table(df, ["k"], [], "v", "sum").collect()} == {"r": 6.0, "(En blanco)": 5.0}
