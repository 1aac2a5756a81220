"""Hand-computed profile fixtures (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.scalar import CATEGORICAL, NUMERIC, TEMPORAL
from colscope.operators.distributions import interval_labels, right_closed_edges
from colscope.operators.profile import fences, profile
from colscope.operators.semtypes import semantic_types


def one_col(spark, values, dtype=T.DoubleType(), name="x"):
    schema = T.StructType([T.StructField(name, dtype, True)])
    return spark.createDataFrame([(v,) for v in values], schema)


def test_outliers_and_quartiles(spark):
    p = profile(one_col(spark, [float(i) for i in range(1, 10)] + [100.0]))
    v = p.variables[0]
    assert v.quartiles[0] == pytest.approx(3.25) and v.quartiles[2] == pytest.approx(7.75)
    assert fences(3.25, 7.75) == pytest.approx((-3.5, 14.5))
    assert v.outliers == 1


def test_zero_iqr_means_no_outliers(spark):
    v = profile(one_col(spark, [5.0, 5.0, 5.0, 5.0, 99.0])).variables[0]
    assert v.quartiles[0] == 5.0 and v.quartiles[2] == 5.0
    assert v.outliers == 0


def test_histogram_right_closed(spark):
    v = profile(one_col(spark, [float(i) for i in range(1, 10)] + [100.0])).variables[0]
    assert [c for _, c in v.histogram] == [9, 0, 0, 0, 1]
    edges = right_closed_edges(1.0, 100.0, 10)
    assert edges[0] == pytest.approx(0.901)
    assert v.histogram[0][0].startswith("(0.901, ")


def test_histogram_single_value(spark):
    v = profile(one_col(spark, [5.0, 5.0, 5.0])).variables[0]
    assert v.histogram == [("(4.995, 5.005]", 3)]


def test_histogram_zero(spark):
    v = profile(one_col(spark, [0.0, 0.0])).variables[0]
    assert v.histogram == [("(-0.001, 0.001]", 2)]
    assert interval_labels([-0.001, 0.001]) == ["(-0.001, 0.001]"]


def test_mode_tie_takes_smallest(spark):
    p = profile(one_col(spark, ["b", "a", "a", "b", "c"], T.StringType()))
    d = p.detail(p.variables[0])
    assert dict(d["stats"])["Más frecuente"] == "a"
    assert dict(d["stats"])["Valores únicos"] == "3"


def test_single_value_std_is_zero(spark):
    p = profile(one_col(spark, [7.0]))
    d = p.detail(p.variables[0])
    assert dict(d["stats"])["Desv. estándar"] == "0"


def test_completeness(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, 5.0)], "a double, b double")
    assert profile(df, details=False).summary_row()["completeness"] == 83.3


def test_temporal_ratio(spark):
    dates = ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01", "x"]
    assert semantic_types(one_col(spark, dates, T.StringType())) == [("x", TEMPORAL)]
    assert semantic_types(one_col(spark, dates[:2] + ["x"], T.StringType())) == [("x", CATEGORICAL)]


def test_numeric_detail_format(spark):
    p = profile(one_col(spark, [1234567.891, 2.0]))
    stats = dict(p.detail(p.variables[0])["stats"])
    assert stats["Máximo"] == "1.234.567,89"
    assert stats["Cuartiles"].startswith("Q1 ")


def test_integer_min_max_printed_as_is(spark):
    p = profile(one_col(spark, [3, 10], T.LongType()))
    stats = dict(p.detail(p.variables[0])["stats"])
    assert stats["Mínimo"] == "3" and stats["Máximo"] == "10"


def test_percentages_of_non_null(spark):
    p = profile(one_col(spark, ["a", "a", "b", None], T.StringType()))
    d = p.detail(p.variables[0])
    assert d["percentages"] == [("a", 66.7), ("b", 33.3)]


def test_nan_counts_as_missing(spark):
    v = profile(one_col(spark, [1.0, float("nan"), 3.0])).variables[0]
    assert v.nulls == 1 and v.valid == 2
    assert v.kind == NUMERIC


def test_approximate_quartiles_option(spark):
    df = one_col(spark, [float(i) for i in range(1, 1001)])
    exact = profile(df, details=False).variables[0].quartiles
    approx = profile(df, details=False, exact=False).variables[0].quartiles
    assert exact == (250.75, 500.5, 750.25)
    assert all(abs(a - e) <= 1.0 for a, e in zip(approx, exact))


def test_number_format_column(spark):
    from colscope.functions.scalar import format_number_es
    df = spark.createDataFrame([(1234567.891,), (None,)], "x double")
    assert [r[0] for r in df.select(format_number_es(df["x"])).collect()] == ["1.234.567,89", "N/D"]


def test_whole_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(2**53 + 1, -(2**62) - 1), (5, 7)], "a long, b long")
    shown = {r.variable: dict((s.label, s.value) for s in r.stats) for r in profile(df).details_frame().collect()}
    assert shown["a"]["Máximo"] == "9007199254740993" and shown["b"]["Mínimo"] == str(-(2**62) - 1)


def _numpy_quartiles(values):
    import numpy as np
    return tuple(float(q) for q in np.quantile(np.array(values), [0.25, 0.5, 0.75])) if values else (None, None, None)


@pytest.mark.parametrize("rows, few", [(0, 50_000), (1, 50_000), (5, 0), (5, 50_000), (20_000, 0), (20_000, 50_000)])
def test_bracketed_quartiles_are_exact(spark, monkeypatch, rows, few):
    """Unique, tied, constant, missing and infinite values; the variable table and the details agree."""
    import random

    from colscope.operators import profile as module
    monkeypatch.setattr(module, "_FEW_VALUES", few)
    rng = random.Random(rows)
    data = [(rng.random(), float(rng.randrange(4)), 3, None if k % 3 else float(k), None, float("inf") if k % 5 == 0 else rng.gauss(0, 1)) for k in range(rows)]
    df = spark.createDataFrame(data, "u double, t double, c long, m double, n double, i double")
    slim = {v.name: v for v in profile(df, details=False).variables}
    for place, name in enumerate(df.columns):
        values = [r[place] for r in data if r[place] is not None and abs(r[place]) != float("inf")]
        want = _numpy_quartiles([float(v) for v in values])
        assert slim[name].quartiles == (pytest.approx(want) if values else want), name
    if rows <= 5:
        assert [v.quartiles for v in profile(df).variables] == [v.quartiles for v in slim.values()]


def test_a_bracket_that_misses_gives_way(spark, monkeypatch):
    from colscope.operators import profile as module
    monkeypatch.setattr(module, "_MARGIN", -0.2)
    df = spark.range(1000).select((F.col("id") * 1.5).alias("v"))
    assert profile(df, details=False).variables[0].quartiles == (374.625, 749.25, 1123.875)


def test_a_profile_leaves_no_tables(spark):
    import os
    from colscope import session
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "b")], "v double, s string")
    profile(df).details_frame().collect()
    profile(df, details=False).variables_frame().collect()
    assert set(os.listdir(folder)) == before
