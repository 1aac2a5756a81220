"""Readers, upload validation, profile store."""

import csv
import io
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.scalar import NUMERIC
from colscope.operators.profile import profile
from colscope.sources import records
from colscope.sources.readers import SourceError, dedupe_headers, read_csv, read_table
from colscope.sources.store import (
    load_or_compute_profile, load_profile, profile_context, profile_record, profile_tables, save_profile, stored_answer, variable_detail,
)
from colscope.sources.validation import ValidationError, validate_source


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_na_tokens_and_types(spark, tmpdir_path):
    path = write(tmpdir_path, "t.csv", "a,b,c,d\n10.5,1,x,\nNA,2,y,\n,3,null,\n")
    df = read_table(spark, path)
    types = {f.name: f.dataType for f in df.schema.fields}
    assert isinstance(types["a"], T.DoubleType) and isinstance(types["b"], T.LongType)
    assert isinstance(types["c"], T.StringType) and isinstance(types["d"], T.DoubleType)
    rows = df.collect()
    assert [r["a"] for r in rows] == [10.5, None, None]
    assert [r["c"] for r in rows] == ["x", "y", None]
    v = {x.name: x for x in profile(df).variables}
    assert v["d"].kind == NUMERIC and v["d"].quartiles == (None, None, None) and v["d"].outliers == 0


def test_duplicate_headers(spark, tmpdir_path):
    assert dedupe_headers(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    path = write(tmpdir_path, "d.csv", "a,a,b\n1,2,3\n")
    assert read_table(spark, path).columns == ["a", "a.1", "b"]


def test_reference_recalculation_fixture(spark, tmpdir_path):
    path = write(tmpdir_path, "auditoria_datos.csv", "id,valor\n1,10.5\n2,20.0\n3,30.5\n")
    s = profile(read_table(spark, path)).summary_row()
    assert s["rows"] == 3 and s["variables"] == 2


def test_unsupported_format(spark, tmpdir_path):
    path = write(tmpdir_path, "x.exe", "hello")
    with pytest.raises(SourceError):
        read_table(spark, path)


def _report(spark, path):
    return {r["rule"]: (r["passed"], r["message"]) for r in validate_source(spark, path).collect()}


def test_validation_rules(spark, tmpdir_path):
    bad = _report(spark, write(tmpdir_path, "payload_malicioso.exe", "MZ"))
    assert bad["format"][0] is False and bad["size"][0] is None
    empty = _report(spark, write(tmpdir_path, "vacio.csv", ""))
    assert empty["format"][0] is True and empty["size"][0] is False
    one = _report(spark, write(tmpdir_path, "mal_estructurado.csv", "columna_unica\ndato\ndato\n"))
    assert one["structure"][0] is False and "estructura" in one["structure"][1]
    good = _report(spark, write(tmpdir_path, "ok.csv", "col1,col2\n1,2\n"))
    assert all(v[0] for v in good.values())
    with pytest.raises(ValidationError):
        validate_source(spark, os.path.join(tmpdir_path, "vacio.csv"), raise_on_error=True)


def test_store_roundtrip(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "b")], "v double, s string")
    assert load_profile(spark, store, 5) is None
    tables = load_or_compute_profile(spark, store, 5, df)
    assert tables["summary"].first()["rows"] == 3
    # a second dataset does not replace the first one's partition
    load_or_compute_profile(spark, store, 6, df.limit(1))
    assert load_profile(spark, store, 5)["summary"].first()["rows"] == 3
    assert variable_detail(tables["details"], "s").first()["variable"] == "s"
    assert variable_detail(tables["details"], "nope").first()["variable"] == "v"
    ctx = json.loads(profile_context(tables, {"id": 5, "name": "t", "file_name": "t.csv"}).first()["context"])
    assert ctx["resumen"]["rows"] == 3 and set(ctx["detalles_variables"]) == {"v", "s"}


def test_failed_save_leaves_the_old_profile(spark, tmpdir_path, monkeypatch):
    store = os.path.join(tmpdir_path, "store")
    old = profile_tables(profile(spark.createDataFrame([(1.0,), (2.0,)], "v double")))
    new = profile_tables(profile(spark.createDataFrame([(1, "a")] * 5, "w int, s string")))
    assert save_profile(old, store, 3) == 1
    broken = dict(new, details=new["details"].select(F.raise_error(F.lit("disk full")).alias("x")))
    with pytest.raises(Exception):
        save_profile(broken, store, 3)
    assert load_profile(spark, store, 3)["summary"].first()["rows"] == 2
    assert [r["variable"] for r in load_profile(spark, store, 3)["variables"].collect()] == ["v"]
    assert [save_profile(new, store, 3) for _ in range(3)] == [2, 3, 4]
    assert load_profile(spark, store, 3)["summary"].first()["rows"] == 5
    record = profile_record(spark, store, 3).collect()
    assert len(record) == 1 and record[0].version == 4 and record[0].size_mb > 0 and record[0].path.endswith("version=4")
    assert sorted(os.listdir(os.path.join(store, "dataset_id=3"))) == ["manifest", "version=3", "version=4"]
    answer = stored_answer(spark, store, 3, "s").collect()
    assert len(answer) == 1 and answer[0].summary.rows == 5 and answer[0].selected == "s" and answer[0].detail.variable == "s"
    assert [v.variable for v in answer[0].variables] == ["w", "s"] and answer[0].saved_at == record[0].saved_at
    assert stored_answer(spark, store, 4) is None and profile_record(spark, store, 4).collect() == []


def _csv_file(folder, text):
    path = os.path.join(folder, "t.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_record_with_too_many_fields_is_refused(spark, tmpdir_path):
    with pytest.raises(SourceError):
        read_csv(spark, _csv_file(tmpdir_path, "a,b\n1,2\n3,4,5\n"))


def test_short_record_is_filled(spark, tmpdir_path):
    assert [tuple(r) for r in read_csv(spark, _csv_file(tmpdir_path, "a,b\n1,2\n3\n")).collect()] == [(1, 2), (3, None)]


def test_quotes_and_line_breaks(spark, tmpdir_path):
    df = read_csv(spark, _csv_file(tmpdir_path, '"he\nad",b\n"x ""y"" z","one\ntwo"\n'))
    assert df.columns == ["he\nad", "b"] and [tuple(r) for r in df.collect()] == [('x "y" z', "one\ntwo")]


@pytest.mark.parametrize("text", ["a,b\n1,2\n3,4,,5\n", "a,b\n1,2,\n", "a,b\n1,2,3,4,5,6,7,8\n", 'a,b\n"x\ny",2,\n', 'a,b\n1,"2"\n"3",4,,,\n'])
def test_every_surplus_field_is_refused(spark, tmpdir_path, text):
    with pytest.raises(SourceError):
        read_csv(spark, _csv_file(tmpdir_path, text))
    assert _report(spark, os.path.join(tmpdir_path, "t.csv"))["structure"][0] is False


@pytest.mark.parametrize("text", ['a,b\n1,"open\n2,3\n', "", "\n\n"])
def test_unclosed_and_empty_files_are_refused(spark, tmpdir_path, text):
    with pytest.raises(SourceError):
        read_csv(spark, _csv_file(tmpdir_path, text))


def test_loose_quotes_and_carriage_returns(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "t.csv"), "w", newline="") as f:
        f.write('a,b\r\n5" pipe,"one\r\ntwo"\r\n\r\n7" pipe,x\r\n')
    rows = [tuple(r) for r in read_csv(spark, os.path.join(tmpdir_path, "t.csv")).collect()]
    assert rows == [('5" pipe', "one\r\ntwo"), ('7" pipe', "x")]


@pytest.mark.parametrize("seed, split", [(1, 120), (2, 211)])
def test_one_file_is_read_by_many_tasks(spark, tmpdir_path, seed, split):
    """Quoted line breaks over the ends of splits, some fields longer than a split; pandas reads the same records."""
    rng = random.Random(seed)
    words = ["plain", "with, comma", 'a "quoted" word', "two\nlines", "\n", '"', '"\n"', "\n,\n", "x" * 30 + "\n" + "y" * 90, "naïve 東京", "NA", "-"]
    rows = [[k, *(rng.choice(words) + rng.choice(["", str(k)]) for _ in range(3))] for k in range(70)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "a", "b\nb", "c"], *rows])
    path = _csv_file(tmpdir_path, out.getvalue())
    settings = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        tasks = spark.read.text(path).rdd.getNumPartitions()
        assert tasks > 10
        got = read_csv(spark, path)
        found = sorted(tuple(r) for r in got.select("id", *(f"`{c}`" for c in got.columns[1:])).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = pd.read_csv(path).astype(object)
    assert got.columns == list(want.columns)
    assert found == [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]


def test_quotes_are_followed_line_by_line():
    for line, inside, open_ in [("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('a"', False, False), ('a"', True, False), ('""', False, False),
                                ('"""', False, True), ('x,"a""', False, True), ('"a"tail",b', False, False), ('a","b', True, True), ("", False, False), ("", True, True)]:
        assert records.ends_open(line, inside) is open_, (line, inside)


def test_type_suffix_is_text(spark, tmpdir_path):
    df = read_csv(spark, _csv_file(tmpdir_path, "code,n,e\n10d,1,1e3\n20f,-2,.5\n"))
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double"]


def test_store_failures_are_not_swallowed(spark, tmpdir_path):
    assert load_profile(spark, os.path.join(tmpdir_path, "nowhere"), 1) is None
    with pytest.raises(Exception):
        load_profile(spark, "nosuchscheme://x/y", 1)
