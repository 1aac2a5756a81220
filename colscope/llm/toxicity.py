"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

The network (``bigru``) is trained in numpy on a bounded sample of labelled rows and scores all overlapping windows
of every whole text; a text has the score of its highest window.

Defined results: NULL text counts as empty, and empty texts get the share of toxic rows (below 0.5); a
NULL doc_id is hashed as the empty string; of labels that share a doc_id the highest counts; rows that repeat are scored each on
its own; without labels of both kinds every text gets nearly the same score below 0.5; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm import bigru
from colscope.llm.common import id_and_text, text_chunks
from colscope.llm.sampling import bounded_sample
from colscope.session import Scratch

#: Most rows of either label that the network is trained on, and the longest text among them.
MAX_TOXIC, MAX_OTHER, MAX_CHARS = 1_500, 3_000, 100_000
#: Characters that are scored at a time in a task.
_CHUNK = 1_500_000


def held_out(key: Column) -> Column:
    """True for the fifth of the rows that is never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> bigru.Model:
    """The network from labelled rows outside the held-out fifth; ``docs`` has doc_id and text."""
    marked = (labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id"))))
    rows = docs.where(~held_out(F.col("doc_id"))).join(marked, "doc_id")
    # Ids first: texts are read for the sample alone.
    with Scratch() as tables:
        ids = tables.keep(rows.where(F.length("text") <= MAX_CHARS).select("doc_id", "toxic").distinct())
        counts = {bool(r["toxic"]): r["count"] for r in ids.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
        parts = [bounded_sample(ids.where(F.col("toxic") > 0), "doc_id", MAX_TOXIC), bounded_sample(ids.where(F.col("toxic") <= 0), "doc_id", MAX_OTHER)]
        chosen = tables.keep(parts[0].union(parts[1]))
        sample = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    total = sum(counts.values())
    return bigru.train(sample.column("text").to_pylist(), (sample.column("toxic").to_numpy() > 0).astype(np.float32),
                       counts.get(True, 0) / total if total else 0.0)


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for ids, texts in text_chunks(batches, _CHUNK):
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(bigru.score_texts(model, texts), pa.float64())], ["doc_id", "score"])


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = id_and_text(docs, key, text)
    model = fit(rows, labels)
    model._moments.clear()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(lambda it: _scored(it, shared), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
