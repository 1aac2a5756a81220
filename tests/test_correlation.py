"""Correlation fixtures and brute-force cross-checks (Spearman, Kendall, p-values)."""

import math
import time
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.functions.stats import NORMAL_FROM, pearson_pvalue
from colscope.operators import correlation as corr
from colscope.operators import rank_correlation


def cells(df, method="pearson", strategy="ignorar"):
    cols = corr.select_numeric(df)
    ready = corr.apply_null_strategy(df, cols, strategy)
    out = corr.heatmap_cells(corr.matrix_pairs(ready, cols, method), cols).collect()
    return {(r["id_x"], r["id_y"]): r["valor"] for r in out}


def test_pairwise_vs_listwise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 8.0)], "a double, b double")
    assert cells(df)[("a", "b")] == 1.0
    pairs = corr.pearson_pairs(corr.numeric_frame(df, ["a", "b"]), ["a", "b"]).collect()
    assert {(r["i"], r["j"]): r["n"] for r in pairs}[(0, 1)] == 2


def test_constant_column_gives_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "c double, d double")
    got = cells(df)
    assert got[("c", "d")] is None and got[("c", "c")] is None and got[("d", "d")] == 1.0


def test_mean_imputation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, 3.0)], "a double, b double")
    ready = corr.apply_null_strategy(df, ["a", "b"], "imputar_promedio")
    assert [r["a"] for r in ready.collect()] == [1.0, 2.0, 3.0]


def test_spearman_with_nulls(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, 2.0), (2.0, 3.0), (None, 4.0), (5.0, None)], "a double, b double")
    assert cells(df, "spearman")[("a", "b")] == -0.5


def test_fewer_than_two_numeric(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, s string")
    with pytest.raises(corr.CorrelationError):
        corr.select_numeric(df)


def test_unknown_method_and_strategy(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(corr.CorrelationError):
        corr.correlation_report(df, method="bogus")
    with pytest.raises(corr.CorrelationError):
        corr.correlation_report(df, strategy="bogus")


def test_strong_pair_edges(spark):
    pairs = spark.createDataFrame([(0, 1, 10, 0.69996), (0, 2, 10, -0.7), (1, 2, 10, 0.5)], "i int, j int, n long, r double")
    got = corr.strong_pairs(pairs, ["a", "b", "c"]).collect()
    assert [(r["variable_1"], r["variable_2"], r["coefficient"], r["kind"]) for r in got] == [
        ("a", "b", 0.7, "Directa"), ("a", "c", -0.7, "Inversa")]
    keys = corr.key_variables(corr.strong_pairs(pairs, ["a", "b", "c"])).collect()
    assert [(r["variable"], r["count"]) for r in keys] == [("a", 2), ("b", 1), ("c", 1)]


def test_omission_notice():
    assert corr.omission_notice({"a": 1, "b": 0}, "ignorar").startswith("Informa: Se detectaron nulos")
    assert corr.omission_notice({"a": 1}, "eliminar_filas") == ""
    assert corr.omission_notice({"a": 0}, "ignorar") == ""


def _avg_ranks(x):
    x = np.asarray(x)
    order = np.argsort(x, kind="mergesort")
    ranks = np.empty(len(x))
    sx = x[order]
    i = 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and sx[j + 1] == sx[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2.0 + 1
        i = j + 1
    return ranks


def _tau_b(x, y):
    n = len(x)
    s = n1 = n2 = 0
    for a in range(n):
        for b in range(a + 1, n):
            dx, dy = np.sign(x[a] - x[b]), np.sign(y[a] - y[b])
            s += dx * dy
            n1 += dx == 0
            n2 += dy == 0
    n0 = n * (n - 1) / 2
    den = (n0 - n1) * (n0 - n2)
    return None if den <= 0 else s / math.sqrt(den)


def _random_frame(spark, n=120, seed=7):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rnd.choice([None, 1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 6.0])
        b = None if rnd.random() < 0.1 else float(rnd.randint(0, 9))
        c = (a or 0) * 2 + rnd.random() if rnd.random() > 0.1 else None
        rows.append((a, b, c))
    return spark.createDataFrame(rows, "a double, b double, c double"), rows


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_methods_against_brute_force(spark, method):
    df, rows = _random_frame(spark)
    got = cells(df, method)
    names = ["a", "b", "c"]
    for i in range(3):
        for j in range(i + 1, 3):
            pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            x = np.array([p[0] for p in pairs])
            y = np.array([p[1] for p in pairs])
            if method == "spearman":
                want = float(np.corrcoef(_avg_ranks(x), _avg_ranks(y))[0, 1])
            else:
                want = _tau_b(x, y)
            assert got[(names[j], names[i])] == pytest.approx(round(want, 4), abs=1e-4)
            assert got[(names[i], names[j])] == got[(names[j], names[i])]


def _pvalue_by_integration(r, n):
    # two-sided p of Pearson r: integrate the density of r under H0 from |r| to 1
    nu = n - 2
    grid = np.linspace(abs(r), 1.0, 400001)
    logc = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi)
    dens = np.exp(logc + (nu / 2 - 1) * np.log(np.clip(1 - grid ** 2, 1e-300, None)))
    return 2 * np.trapezoid(dens, grid)


@pytest.mark.parametrize("r,n", [(0.3, 10), (0.05, 60), (-0.8, 6), (0.5, 30)])
def test_pvalue_matches_integration(r, n):
    assert pearson_pvalue(r, n) == pytest.approx(_pvalue_by_integration(r, n), abs=2e-5)


def test_pvalue_special_cases():
    assert pearson_pvalue(0.4, 1) is None
    assert pearson_pvalue(None, 10) is None
    assert pearson_pvalue(1.0, 2) == 1.0
    assert pearson_pvalue(1.0, 10) == 0.0


def test_significance_table(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 3.9, 0.0), (3.0, 6.1, 1.0), (4.0, 8.0, 0.5), (None, 1.0, 2.0)],
                               "a double, b double, c double")
    rep = corr.correlation_report(df)
    sig = {(r["id_y"], r["id_x"]): r["p_value"] for r in rep["significance"].collect()}
    assert sig[("a", "a")] == 0.0 and len(sig) == 9
    assert sig[("a", "b")] == sig[("b", "a")] and sig[("a", "b")] < 0.01


def test_spearman_mixed_null_free_and_null_columns(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(150):
        a = float(rnd.randint(0, 20))                    # no nulls, ties
        b = a * 0.5 + rnd.random()                       # no nulls
        c = -a + rnd.randint(0, 3)                       # no nulls, ties
        d = None if rnd.random() < 0.2 else rnd.random() + a / 10
        rows.append((a, b, c, d))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    num = corr.numeric_frame(df, names)
    assert rank_correlation.presence_classes([0, 0, 0, 5]) == [0, 0, 0, 1]
    got = {(names[r["j"]], names[r["i"]]): round(r["r"], 4) for r in corr.spearman_pairs(num, names).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            x = np.array([p[0] for p in pairs])
            y = np.array([p[1] for p in pairs])
            want = float(np.corrcoef(_avg_ranks(x), _avg_ranks(y))[0, 1])
            assert got[(names[j], names[i])] == pytest.approx(round(want, 4), abs=1e-4)


def _rank_frame(spark, seed, n=400):
    """Heavy ties, a value that fills a third of a column, missing values, a constant, infinities, an empty column."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        a = float(rnd.choice([3, 3, rnd.randrange(60)]))
        b = None if rnd.random() < 0.2 else a + rnd.randrange(-20, 20)
        rows.append((a, b, rnd.random(), float(k % 3), None if rnd.random() < 0.3 else -a * rnd.random(), 7.0,
                     rnd.choice([float("inf"), -float("inf"), 1.0, 2.0, 0.0, -0.0]), None, float(k) if k < 3 else None))
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(9))), rows


@pytest.mark.parametrize("seed, strip_rows", [(1, 100_000), (2, 7)])
@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_methods_on_odd_columns(spark, monkeypatch, method, seed, strip_rows):
    monkeypatch.setattr(rank_correlation, "STRIP_ROWS", strip_rows)
    monkeypatch.setattr(rank_correlation, "RANGE_ROWS", strip_rows)
    df, rows = _rank_frame(spark, seed)
    names = df.columns
    pairs = corr.spearman_pairs(df, names) if method == "spearman" else corr.kendall_pairs(df, names)
    got = {(r.i, r.j): (r.n, r.r) for r in pairs.collect()}
    for i in range(9):
        for j in range(i + 1, 9):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            x, y = (np.array([p[s] for p in both]) for s in (0, 1))
            if not both:
                assert (i, j) not in got
                continue
            assert got[i, j][0] == len(both)
            if len(set(x)) < 2 or len(set(y)) < 2:
                assert got[i, j][1] is None
                continue
            want = float(np.corrcoef(_avg_ranks(x), _avg_ranks(y))[0, 1]) if method == "spearman" else _tau_b(_avg_ranks(x), _avg_ranks(y))
            assert got[i, j][1] == pytest.approx(want, abs=1e-9), (i, j)


def test_more_classes_than_a_word_has_bits(spark):
    """70 columns with a missing value each: the second word of presence bits counts too."""
    rows = [tuple(None if k == c else float((k * (c + 3)) % 101) for c in range(70)) for k in range(101)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(70)))
    got = {(r.i, r.j): (r.n, r.r) for r in corr.spearman_pairs(df, df.columns).collect()}
    assert len(got) == 70 * 69 // 2
    for i, j in ((0, 1), (3, 69), (61, 68)):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        x, y = (_avg_ranks(np.array([p[s] for p in both])) for s in (0, 1))
        assert got[i, j] == (99, pytest.approx(float(np.corrcoef(x, y)[0, 1])))


@pytest.mark.parametrize("seed", range(3))
def test_inversions(seed):
    values = np.random.default_rng(seed).integers(0, [3, 50, 1000][seed], 300)
    assert rank_correlation.inversions(values) == sum(int((values[k + 1:] < values[k]).sum()) for k in range(300))
    assert rank_correlation.inversions(values[:0]) == 0 and rank_correlation.inversions(values[:1]) == 0


def test_infinity_gives_null_whatever_the_batches(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"),
                                    F.when(F.col("id") == 777, float("inf")).otherwise(F.col("id").cast("double")).alias("c"))
    for parts in (1, 5):
        got = {(r.i, r.j): (r.n, r.r) for r in corr.pearson_pairs(df.repartition(parts), ["a", "b", "c"]).collect()}
        assert got[0, 1] == (20_000, pytest.approx(1.0))
        assert got[0, 2] == (20_000, None) and got[1, 2] == (20_000, None) and got[2, 2] == (20_000, None)


def test_constant_side_has_no_rank_correlation(spark):
    df = spark.range(3_017).select(F.lit(5.0).alias("a"), F.col("id").cast("double").alias("b"),
                                   F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("c"))
    got = {(r.i, r.j): r.r for r in corr.spearman_pairs(df, ["a", "b", "c"]).collect()}
    assert got[0, 1] is None and got[0, 2] is None and got[1, 2] == pytest.approx(1.0)


def test_p_values_of_very_many_rows():
    for n in (10**6, 10**9, 10**11, 10**12):
        for z in (0.1, 0.5, 1.0, 1.96, 3.0):
            assert pearson_pvalue(z / math.sqrt(n), n) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-6)
    # Both ways agree where they meet.
    for r in (0.001, 0.005, 0.01):
        assert pearson_pvalue(r, NORMAL_FROM + 1) == pytest.approx(pearson_pvalue(r, NORMAL_FROM + 2), abs=1e-5)


def test_tasks_that_deal_out_cells_do_not_follow_the_input(spark, monkeypatch):
    """One partition of 12,000 rows is dealt out by 12 tasks of 1,000 rows, and their cells by tasks of one range each."""
    from colscope.operators import rank_correlation
    monkeypatch.setattr(rank_correlation, "FILE_CELLS", 2_000, raising=False)
    monkeypatch.setattr(rank_correlation, "SPLIT_BYTES", 4 << 20, raising=False)
    monkeypatch.setattr(rank_correlation, "RANGE_ROWS", 500)
    df = spark.range(0, 12_000, 1, 1).selectExpr("id % 977 as a", "if(id % 7 = 0, null, id % 31) as b")
    dealt, scan = [], "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(scan)

    def counting(method):
        return lambda self, *args: dealt.append(self.rdd.getNumPartitions()) or method(self, *args)

    for name in ("repartitionByRange", "repartition"):
        monkeypatch.setattr(type(df), name, counting(getattr(type(df), name)))
    got = [(r.i, r.j, r.n) for r in corr.spearman_pairs(df, ["a", "b"]).collect()]
    assert got == [(0, 1, 10_285)]
    assert dealt[0] == 12 and dealt[1] >= 40
    assert spark.conf.get(scan) == before


def test_spearman_deals_out_a_bounded_number_of_cells_at_a_time(spark, monkeypatch):
    """Steps of one column, then of some rows; no step's shuffle files outlive it; columns missing in the same rows share their ranks."""
    monkeypatch.setattr(rank_correlation, "STEP_CELLS", 4_000, raising=False)
    monkeypatch.setattr(rank_correlation, "RANGE_ROWS", 1_000)
    df = spark.range(0, 3_000, 1, 4).selectExpr("id * 7919 % 977 as a", "if(id % 10 = 0, null, id % 31) as b", "if(id % 10 = 0, null, id * id % 13) as c",
                                                "if(id % 10 = 3, null, id % 59) as d")
    twins = rank_correlation._twins(df.toDF("c0", "c1", "c2", "c3"), [0, 300, 300, 300])
    assert twins == {2: 1} and rank_correlation.presence_classes([0, 300, 300, 300], twins) == [0, 1, 1, 2]
    dealt = {"repartitionByRange": [], "repartition": []}

    def counting(method, counts):
        def run(self, *args):
            counts.append(self.count())
            return method(self, *args)
        return run

    for name, counts in dealt.items():
        monkeypatch.setattr(type(df), name, counting(getattr(type(df), name), counts))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffled()
    got = {(r.i, r.j): (r.n, r.sab / math.sqrt(r.saa * r.sbb)) for r in rank_correlation.spearman_sums(df, df.columns, [0, 300, 300, 300]).collect()}
    assert dealt["repartitionByRange"] == [3_000, 2_700, 2_700, 2_700]
    assert len(dealt["repartition"]) == 3 and sum(dealt["repartition"]) == 11_100 and max(dealt["repartition"]) < 4_300
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    rows = df.collect()
    for i in range(4):
        for j in range(i + 1, 4):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            x, y = (_avg_ranks(np.array([p[s] for p in both], float)) for s in (0, 1))
            assert got[i, j] == (len(both), pytest.approx(float(np.corrcoef(x, y)[0, 1])))
