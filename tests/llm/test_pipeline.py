import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
import corpus_pipeline
from colscope.llm import bpe, quality
from colscope.llm.common import read_table
from colscope.session import reliable_checkpoint

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@needs_data
def test_stages(spark):
    documents = read_table(spark, SF, "documents")
    docs, sizes = documents, [documents.count()]
    model = bpe.load(bpe.read_spec(corpus_pipeline.TOKENIZER))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = reliable_checkpoint(stage(spark, docs, SF))
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ids = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.piece)):
        ids.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert {i: [*model.ids(t).tolist(), 2] for i, t in texts.items()} == ids
    benchmark = [r.text for r in read_table(spark, SF, "benchmark").collect()]
    assert not any(item in text for item in benchmark for text in texts.values())


@needs_data
def test_quality_stage_keeps_what_labels_call_good(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, read_table(spark, folder, "documents"), folder).select("doc_id").collect()}
    judged = {r.doc_id: r for r in quality.text_statistics(read_table(spark, folder, "documents")).withColumn("failed", quality.base_failed()).collect()}
    labels = [(r.doc_id, r.quality) for r in read_table(spark, folder, "labels").collect() if not judged[r.doc_id].failed]
    good, bad = ([i for i, q in labels if q == want] for want in (1, 0))
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)


@needs_data
def test_run_is_the_stages_in_turn(spark):
    from colscope import session
    before = set(session._LIVE)
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"}
    assert len(set(session._LIVE) - before) == 1  # only the result's table is left
    assert got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


@needs_data
def test_every_operator_is_registered():
    names = list(entry_mod.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_stages_on_odd_rows(spark, table, odd_rows, tmp_path):
    empty = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    for rows in (odd_rows, []):
        docs = columns = table(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = reliable_checkpoint(stage(spark, docs, empty))
            assert docs.columns == columns.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, empty)
        assert (pieces.count() > 0) == bool(rows)
