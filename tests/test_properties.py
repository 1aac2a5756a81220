"""Property checks: invariance under row order / partitioning, symmetric matrix, counts add up."""

import random

from colscope.operators import correlation as corr
from colscope.operators.distributions import histogram_frame
from colscope.operators.profile import profile


def _frame(spark, seed, parts):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, rnd.random() * 100]), float(rnd.randint(0, 5)), rnd.choice(["a", "b", "c", None]))
            for _ in range(300)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "x double, y double, s string").repartition(parts)


def test_profile_invariant_to_order_and_partitions(spark):
    a = profile(_frame(spark, 1, 1)).variables_frame().collect()
    b = profile(_frame(spark, 1, 7)).variables_frame().collect()
    assert a == b


def test_matrix_symmetric_and_bounded(spark):
    df = _frame(spark, 2, 3)
    for method in ["pearson", "spearman", "kendall"]:
        num = corr.numeric_frame(df, ["x", "y"])
        cells = corr.heatmap_cells(corr.matrix_pairs(num, ["x", "y"], method), ["x", "y"]).collect()
        got = {(r["id_x"], r["id_y"]): r["valor"] for r in cells}
        assert got[("x", "y")] == got[("y", "x")]
        assert all(v is None or -1.0 <= v <= 1.0 for v in got.values())


def test_histogram_counts_sum_to_non_nulls(spark):
    df = _frame(spark, 3, 4)
    for right in (True, False):
        h = histogram_frame(df, ["x", "y"], right_closed=right).collect()
        for c in ["x", "y"]:
            assert sum(r["count"] for r in h if r["variable"] == c) == df.where(f"{c} IS NOT NULL").count()
