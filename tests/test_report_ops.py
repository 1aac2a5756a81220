"""Balance, selection, chart data, paging, catalog."""

import random

import pytest

from colscope.functions.scalar import NUMERIC
from colscope.operators import balance as bal
from colscope.operators import selection as sel
from colscope.operators.catalog import NotFound, get_dataset, list_datasets
from colscope.operators import paging
from colscope.operators.paging import page_rows
from colscope.operators.profile import profile


def test_balance_levels():
    assert bal.level(80.0, 4.0) == "desbalance marcado"
    assert bal.level(65.0, 1.86) == "desbalance moderado"
    assert bal.level(55.0, 1.22) == "balance relativo"


@pytest.mark.parametrize("a,b,lvl,ratio", [(80, 20, "desbalance marcado", 4.0), (65, 35, "desbalance moderado", 1.86),
                                           (55, 45, "balance relativo", 1.22)])
def test_balance_from_data(spark, a, b, lvl, ratio):
    df = spark.createDataFrame([("yes",)] * a + [("no",)] * b, "outcome string")
    ctx = bal.class_balance(df)
    assert ctx["variable"] == "outcome" and ctx["level"] == lvl and ctx["ratio"] == ratio


def test_target_name_tie(spark):
    df = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    assert bal.class_balance(df)["variable"] == "toxic"


def test_no_target(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "id long, v double")
    assert bal.class_balance(df)["variable"] is None
    row = bal.balance_statement_frame(df).first()
    assert row.variable is None and row.diagnosis == bal.NO_TARGET and row.warning == bal.NO_TARGET_WARNING and row.criterion is None
    assert bal.class_balance_frame(df).collect() == []


def test_columns_at_the_class_bounds(spark):
    """2 and 10 classes are candidates, 1 and 11 are not; a skipped name is none either."""
    rows = [(i % 2, i % 10, i % 11, 1, i % 3, None if i % 4 else f"k{i % 12}") for i in range(440)]
    df = spark.createDataFrame(rows, "two int, ten int, eleven int, one int, user_id int, class string")
    table = bal.class_table(df)
    assert [(r.variable, r.classes) for r in bal.candidates(table).collect()] == [("class", 3), ("two", 2), ("ten", 10)]
    assert bal.class_balance(df)["variable"] == "class"


@pytest.mark.parametrize("seed", range(4))
def test_first_independent_is_the_greedy_walk(seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    graph = np.triu(rng.random((15, 15)) < 0.2, 1)
    graph |= graph.T
    want = []
    for node in range(15):
        if not any(graph[node, other] for other in want):
            want.append(node)
    assert sel.first_independent(graph) == want and sel.first_independent(graph[:0, :0]) == []


def _greedy(order, numeric_names, rabs, limit=12):
    chosen = []
    for n in numeric_names:
        if all(rabs.get((n, m)) is None or rabs[(n, m)] <= 0.7 for m in chosen):
            chosen.append(n)
        if len(chosen) >= limit:
            break
    return chosen


def test_selection_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        x = rnd.random()
        rows.append((x, x * 3 + rnd.random() * 0.01, rnd.random(), None if i % 7 == 0 else rnd.random(),
                     -x + rnd.random() * 0.05, rnd.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, "x double, x3 double, z double, w double, nx double, s string")
    prof = profile(df, details=False)
    got = sel.select_diverse(df, prof)
    order = sorted(prof.variables, key=lambda v: (v.nulls + (v.outliers or 0), v.valid), reverse=True)
    numeric = [v.name for v in order if v.kind == NUMERIC]
    import numpy as np
    cols = {c: [r[i] for r in rows] for i, c in enumerate(df.columns)}
    rabs = {}
    for a in numeric:
        for b in numeric:
            pairs = [(p, q) for p, q in zip(cols[a], cols[b]) if p is not None and q is not None]
            rabs[(a, b)] = abs(float(np.corrcoef([p for p, _ in pairs], [q for _, q in pairs])[0, 1]))
    want = _greedy(order, numeric, rabs) + [v.name for v in order if v.kind != NUMERIC]
    assert [n for n, _ in got] == want
    assert "x3" not in [n for n, _ in got] or "x" not in [n for n, _ in got]


def test_chart_data(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(20)], "v double, s string")
    out = sel.chart_data(df, [("v", NUMERIC), ("s", "Categórica")]).collect()
    hist = [r["count"] for r in out if r["chart"] == "histogram"]
    bars = [(r["label"], r["count"]) for r in sorted(out, key=lambda r: r["position"]) if r["chart"] == "bars"]
    assert sum(hist) == 20 and len(hist) == 10
    assert bars == [("b", 10), ("a", 10)]


def test_pages_of_equal_keys_do_not_overlap(spark):
    rows = [(None if i % 10 == 0 else i % 3, f"s{i % 40}", float("nan") if i % 7 == 0 else float(i % 5)) for i in range(130)]
    df = spark.createDataFrame(rows, "k long, s string, v double")
    seen = []
    for page in range(1, 7):
        got, meta = page_rows(df.repartition(3 + page), ["k", "v"], page=page, size=25)
        seen += [(r.k, r.s, r.v) for r in got.collect()]
    assert sorted(map(str, seen)) == sorted(str((k, s, None if v != v else v)) for k, s, v in rows)
    assert [k for k, _, _ in seen] == sorted((k for k, _, _ in rows), key=lambda k: -1 if k is None else k)


@pytest.mark.parametrize("step, ties", [(3, 100_000), (40, 100_000), (7, 2)])
def test_one_index_serves_all_pages(spark, monkeypatch, step, ties):
    """NULLs, NaN, hot keys and repeated rows; the second page reads marks and ranks nothing."""
    monkeypatch.setattr(paging, "STEP", step)
    monkeypatch.setattr(paging, "MOST_TIES", ties)
    rows = [(None if i % 10 == 0 else float("nan") if i % 11 == 0 else float(i % 3), f"s{i % 40}") for i in range(130)] + [(1.0, "same")] * 60
    df = spark.createDataFrame(rows, "v double, s string")
    index = paging.PageIndex(df, ["v"])
    assert index.total == 190
    seen = []
    calls = []
    ranks = paging.running_before
    monkeypatch.setattr(paging, "running_before", lambda *a, **k: calls.append(a) or ranks(*a, **k))
    for page in range(1, 9):
        got, meta = page_rows(df.repartition(page), ["v"], page=page, size=25, index=index)
        assert meta["total_pages"] == 8
        seen += [(r.v, r.s) for r in got.collect()]
    assert bool(calls) == (ties == 2)
    assert sorted(map(str, seen)) == sorted(str((None if v is None or v != v else v, s)) for v, s in rows)
    place = {None: 0, 0.0: 1, 1.0: 2, 2.0: 3}
    shown = [place[v] for v, _ in seen]
    nulls = sum(v is None for v, _ in rows)
    assert shown[nulls:190 - sum(v is not None and v != v for v, _ in rows)] == sorted(shown[nulls:190 - sum(v is not None and v != v for v, _ in rows)])
    index.drop()


def test_page_with_its_dataset(spark):
    df = spark.createDataFrame([(i,) for i in range(30)], "k long")
    rows, answer = paging.dataset_page({"id": 4, "name": "n", "description": "d", "file_name": None, "path": "/x/ventas.csv"}, df, ["k"], page=2)
    assert (answer["id"], answer["name"], answer["file_name"], answer["format"], answer["current_page"]) == (4, "n", "ventas.csv", "CSV", 2)
    assert [r.k for r in rows.collect()] == [25, 26, 27, 28, 29]


def test_paging(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(26)], "k long, s string")
    rows, meta = page_rows(df, ["k"], page=9, size=25)
    assert meta["current_page"] == 2 and meta["total_pages"] == 2 and not meta["has_next_page"]
    assert meta["has_previous_page"]
    assert [r["k"] for r in rows.collect()] == [25]
    rows, meta = page_rows(df, ["k"], page=1, size=10)
    assert [r["k"] for r in rows.collect()] == list(range(10))


def test_paging_empty(spark):
    df = spark.createDataFrame([], "k long")
    rows, meta = page_rows(df, ["k"])
    assert meta["current_page"] == 1 and meta["total_pages"] == 1 and rows.count() == 0


def test_catalog_owner_scope(spark):
    cat = spark.createDataFrame([
        (1, "a", None, "a.csv", "/x/a.csv", 10, "2024-01-01", 7),
        (2, "b", None, None, "/x/y/b_file.xlsx", 20, "2024-02-01", 7),
        (3, "c", None, "c.csv", "/x/c.csv", 30, "2024-03-01", 8),
    ], "id long, name string, description string, file_name string, path string, size_bytes long, "
       "uploaded_at string, owner_id long")
    reports = spark.createDataFrame([(2,)], "id long")
    out = list_datasets(cat, 7, reports).collect()
    assert [r["id"] for r in out] == [2, 1]
    assert out[0]["file_name"] == "b_file.xlsx" and out[0]["format"] == "XLSX" and out[0]["report_available"]
    assert get_dataset(cat, 1, 7)["name"] == "a"
    with pytest.raises(NotFound):
        get_dataset(cat, 3, 7)


def test_report_tables(spark):
    from colscope.operators import report as rep
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "v double, s string")
    p = profile(df, details=False)
    ind = {r["label"]: r["value"] for r in rep.indicators(p.summary_frame()).collect()}
    assert ind["Registros"] == "3" and ind["Completitud"] == "66.7%" and ind["Atípicos"] == "0"
    app = {r["variable"]: r["outliers"] for r in rep.appendix(p.variables_frame()).collect()}
    assert app == {"v": "0", "s": "N/A"}


def test_safe_download_name(spark):
    from colscope.operators import report as rep
    cat = spark.createDataFrame([(1, "  Ventas 2024 (final) "), (2, "***"), (3, "a-b_c")], "id long, name string")
    got = {r["id"]: r["report_file"] for r in rep.download_names(cat).collect()}
    assert got == {1: "resumen_ejecutivo_Ventas_2024_final.pdf", 2: "resumen_ejecutivo_dataset.pdf",
                   3: "resumen_ejecutivo_a-b_c.pdf"}


def test_coefficient_lookup(spark):
    from colscope.operators import correlation as corr
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9)], "a double, b double")
    cells = corr.correlation_report(df)["heatmap"]
    assert corr.coefficient(cells, "a", "b") == corr.coefficient(cells, "b", "a")
    with pytest.raises(corr.CorrelationError):
        corr.coefficient(cells, "a", "zz")


def test_all_owners_listing_positions(spark):
    from colscope.operators.catalog import list_all_datasets
    rows = [(i, f"d{i}", None, f"f{i}.csv", f"/x/f{i}.csv", i, f"2024-01-{1 + i % 28:02d}", 1 if i % 3 else 2)
            for i in range(60)]
    cat = spark.createDataFrame(rows, "id long, name string, description string, file_name string, path string, "
                                      "size_bytes long, uploaded_at string, owner_id long")
    got = list_all_datasets(cat).collect()
    for owner in (1, 2):
        mine = sorted((r for r in got if r["owner_id"] == owner), key=lambda r: r["position"])
        want = sorted((r for r in rows if r[7] == owner), key=lambda r: (r[6], r[0]), reverse=True)
        assert [r["id"] for r in mine] == [r[0] for r in want]
        assert [r["position"] for r in mine] == list(range(1, len(want) + 1))


def test_report_needs_a_profile(spark, tmpdir_path):
    from colscope.operators import report as rep
    from colscope.sources.store import load_or_compute_profile
    with pytest.raises(rep.ProfileRequired):
        rep.report_tables(spark, tmpdir_path, 1)
    load_or_compute_profile(spark, tmpdir_path, 1, spark.createDataFrame([(2.0,), (None,)], "v double"))
    tables = rep.report_tables(spark, tmpdir_path, 1)
    assert [r.value for r in tables["indicators"].collect()][:2] == ["2", "1"] and tables["appendix"].first().nulls == 1
