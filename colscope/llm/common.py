"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; every other character belongs to a word.
SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch between Spark and Python: rows hold whole texts, so Spark's default of 10,000 would be tens of MB on each side of each task.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_ROWS``, unless it already asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string), text NULL as empty; no other column is read."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def text_chunks(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) in chunks of about ``chars`` characters, so memory does not follow the Arrow batch size."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start, size = 0, 0
        lengths = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64,
                                        count=len(texts) + 1 + texts.offset)[texts.offset:]) if len(texts) else ()
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= chars:
                yield ids.slice(start, i + 1 - start).to_pylist(), texts.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0
        if start < len(texts):
            yield ids.slice(start).to_pylist(), texts.slice(start).to_pylist()


def release_memory() -> None:
    """Give freed memory back: Python workers live on for later stages beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(docs: DataFrame, text: str, make: Callable[[], Callable[[list], pa.Array]], kind: str, arrow: pa.DataType) -> DataFrame:
    """(row, out): whole rows as a struct, and for each text (None as it is) the value of the function that ``make`` builds in every task.

    The function gets texts in chunks, so memory follows neither the batch nor the partition.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"))
    place = docs.columns.index(text)
    schema = T.StructType([rows.schema["row"], T.StructField("out", T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            whole = batch.column(0)
            texts = whole.field(place)
            keys = pa.nulls(len(texts), pa.int64())
            parts = [function(chunk) for _, chunk in text_chunks(iter([pa.record_batch([keys, texts], ["k", "t"])]))]
            yield pa.record_batch([whole, pa.concat_arrays(parts) if parts else pa.array([], arrow)], ["row", "out"])
        release_memory()

    return rows.mapInArrow(run, schema)


def task_number() -> int:
    """Number of the running task's partition; 0 outside a task (unit tests)."""
    context = TaskContext.get()
    return context.partitionId() if context else 0
