"""Token counts without ids: pieces once per distinct pre-token, times its frequency in each document.

1. Every task counts the pre-tokens of its texts; one shuffle makes the table of distinct
   pre-tokens, and the pieces of each are counted there, once in the whole job.
2. The most frequent pre-tokens (at most ``hot``, none longer than ``HOT_CHARS``: a proven bound of size)
   are joined on the map side; frequencies of all others are shuffled to the table.
   So a pre-token that stands in every document never meets in one task.
3. Products are summed per document.

Defined results: NULL text counts as empty (0 bytes, 0 tokens); every row gives one row, also
rows that repeat or share a doc_id; NULL doc_id stays NULL; empty in, empty out.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm import bpe
from colscope.llm.common import id_and_text, task_number, text_chunks
from colscope.session import reliable_checkpoint

#: Most pre-tokens that are joined on the map side, and the longest of them: under 140 MB in all.
HOT = 1 << 19
HOT_CHARS = 64
#: A task's counts are sent on at this many distinct pre-tokens.
_FLUSH = 400_000
#: Histogram steps for each doubling of the count.
_STEPS = 8

#: The map-side table of the last call, by its tag, in each Python worker.
_HOT_TABLES: dict[str, dict[str, int]] = {}


def _counted(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[pa.RecordBatch]:
    model, counts = bpe.load(spec), Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pre_token", "n"])
        counts.clear()
        return out

    for _, texts in text_chunks(batches):
        for text in texts:
            for part in model.parts(text):
                if not isinstance(part, int):
                    counts.update(model.pre_tokens(part))
            if len(counts) >= _FLUSH:
                yield flush()
    if counts:
        yield flush()


def _with_pieces(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[pa.RecordBatch]:
    model = bpe.load(spec)
    for batch in batches:
        pieces = [model.pieces(p) for p in batch.column(0).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], ["pre_token", "n", "pieces"])


def distinct_pre_tokens(docs: DataFrame, spec: str) -> DataFrame:
    """(pre_token, n, pieces): each distinct pre-token of all texts once."""
    found = docs.select("doc_id", "text").mapInArrow(lambda it: _counted(it, spec), "pre_token string, n long")
    return (found.groupBy("pre_token").agg(F.sum("n").alias("n"))
            .mapInArrow(lambda it: _with_pieces(it, spec), "pre_token string, n long, pieces long"))


def _step(n: str = "n"):
    return F.floor(F.log2(F.col(n)) * _STEPS).cast("int")


def hot_pre_tokens(table: DataFrame, hot: int) -> tuple[list[str], np.ndarray]:
    """The pre-tokens above the lowest count step that leaves at most ``hot`` of them."""
    short = table.where(F.length("pre_token") <= HOT_CHARS)
    left, least = hot, None
    for row in sorted(short.groupBy(_step().alias("step")).count().collect(), reverse=True):
        if (left := left - row["count"]) < 0:
            break
        least = row["step"]
    if least is None:
        return [], np.zeros(0, dtype=np.int64)
    rows = short.where(_step() >= least).select("pre_token", "pieces").toArrow()
    return rows.column(0).to_pylist(), rows.column(1).to_numpy()


def _frequencies(batches: Iterator[pa.RecordBatch], spec: str, shared, tag: str) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, n_bytes, pre_token, amount): one with the tokens known here, one per other pre-token."""
    if tag not in _HOT_TABLES:
        _HOT_TABLES.clear()
        words, pieces = shared.value
        _HOT_TABLES[tag] = dict(zip(words, pieces.tolist()))
    known = _HOT_TABLES[tag].get
    model, row = bpe.load(spec), task_number() << 36
    for ids, texts in text_chunks(batches):
        rows, keys, words, amounts, sizes = [], [], [], [], []
        for key, text in zip(ids, texts):
            total, counts = 0, Counter()
            for part in model.parts(text):
                if isinstance(part, int):
                    total += 1
                else:
                    counts.update(model.pre_tokens(part))
            others = 0
            for word, n in counts.items():
                if (pieces := known(word)) is None:
                    words.append(word)
                    amounts.append(n)
                    others += 1
                else:
                    total += n * pieces
            # The key of a document's own row is different everywhere, so these rows spread in the join.
            words.append(str(row))
            amounts.append(total)
            rows += [row] * (others + 1)
            keys += [None] * others + [key]
            sizes += [None] * others + [len(text.encode())]
            row += 1
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                               pa.array(words, pa.string()), pa.array(amounts, pa.int64())],
                              ["row", "doc_id", "n_bytes", "pre_token", "amount"])


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens by the vocabulary file at ``path``."""
    spark, spec = docs.sparkSession, bpe.read_spec(path)
    rows = id_and_text(docs, key, text)
    table = reliable_checkpoint(distinct_pre_tokens(rows, spec))
    shared, tag = spark.sparkContext.broadcast(hot_pre_tokens(table, hot)), uuid.uuid4().hex
    found = rows.mapInArrow(lambda it: _frequencies(it, spec, shared, tag),
                            "row long, doc_id long, n_bytes long, pre_token string, amount long")
    joined = found.join(table.select("pre_token", "pieces"), "pre_token", "left")
    tokens = F.when(F.col("n_bytes").isNotNull(), F.col("amount")).otherwise(F.col("amount") * F.col("pieces"))
    return (joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens"))
