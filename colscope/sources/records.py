"""True records of CSV files that Spark splits at any line, also if quoted fields hold line breaks.

Spark reads the files as lines, each with its split (file and first byte).  A split cannot know whether it
begins inside a quoted field, so it says where it would end in either case; these maps are combined along the file
(one short row per split), and only then are records cut, each split from its true start.  The record that
runs over the end of a split is put together from its pieces, a few rows per split.

A quote opens a field only at the field's start; a doubled quote inside it is a quote; whatever follows the
closing quote belongs to the field.  Lines end with a line feed, with or without a carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.session import Scratch

#: A quote inside an unquoted field or behind a closing one: then the number of quotes does not say whether a line ends inside a field.
_LOOSE_QUOTE = r'(?:^|,)[^",][^,]*"|[^,"]"[^,"]'


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): lines with the split that they come from."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def has_open_lines(lines: DataFrame) -> bool:
    """False if every line surely ends outside quotes, so that lines are records."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not lines.where((quotes % 2 == 1) | F.col("value").rlike(_LOOSE_QUOTE)).isEmpty()


def ends_open(line: str, inside: bool) -> bool:
    """True if the line ends inside a quoted field; ``inside``: it begins in one."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(",", at) + 1
                if at == 0:
                    return False
                continue
            at += 1
        quote = line.find('"', at)
        if quote < 0:
            return True
        if line.startswith('"', quote + 1):
            at, inside = quote + 2, True
            continue
        inside = False
        at = line.find(",", quote + 1) + 1
        if at == 0:
            return False


def _split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, closed, opened) per split: whether it ends inside quotes if it begins outside, and if inside."""
    here, ends, done = None, (False, True), []
    for batch in batches:
        quoted = pc.match_substring(batch.column(0), '"').to_pylist()
        for line, file, start, has in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), quoted):
            if (file, start) != here:
                if here:
                    done.append((*here, *ends))
                here, ends = (file, start), (False, True)
            if has:
                ends = tuple(ends_open(line, e) for e in ends)
    if here:
        done.append((*here, *ends))
    if done:
        yield pa.record_batch([pa.array(c) for c in zip(*done)], ["file", "start", "closed", "opened"])


def splits_begun_inside(lines: DataFrame) -> DataFrame:
    """(file, start) of the splits that begin inside a quoted field: the maps of all earlier splits, applied in turn."""
    maps = lines.mapInArrow(_split_maps, "file bigint, start bigint, closed boolean, opened boolean")
    # A split whose two ends agree decides alone; after it, only splits that swap the two count.
    fixed = F.when(F.col("closed") == F.col("opened"), F.struct("start", F.col("closed").alias("open")))
    swap = F.when(F.col("closed") & ~F.col("opened"), 1).otherwise(0)
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    rows = maps.select("file", "start", fixed.alias("fixed"), swap.alias("swap"))
    rows = rows.select("file", "start", F.last("fixed", True).over(earlier).alias("fixed"), F.sum("swap").over(earlier).alias("swaps"),
                       F.sum("swap").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("with_own"))
    upto = rows.select(F.col("file").alias("f"), F.col("start").alias("at"), F.col("with_own").alias("swaps_then"))
    rows = rows.join(upto, (F.col("file") == F.col("f")) & (F.col("fixed.start") == F.col("at")), "left")
    swaps = F.coalesce("swaps", F.lit(0)) - F.coalesce("swaps_then", F.lit(0))
    begins = F.coalesce(F.col("fixed.open"), F.lit(False)) != (swaps % 2 == 1)
    return rows.where(begins).select("file", "start")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits, and the pieces (part: 0 end, 1 middle, 2 beginning) of those that run over a split's ends."""
    here, pieces, inside, part, first = None, [], False, None, False
    for batch in batches:
        out: list[tuple] = []
        quoted = pc.match_substring(batch.column(0), '"').to_pylist()
        for line, file, start, begun, has in zip(*(batch.column(i).to_pylist() for i in range(4)), quoted):
            if (file, start) != here:
                if pieces:
                    out.append((*here, "\n".join(pieces), 1 if part == 0 else 2, first))
                here, pieces, inside, first = (file, start), [], begun, start == 0
                part = 0 if begun else None
            if has:
                inside = ends_open(line, inside)
            if not inside and not pieces and part is None:
                if line.strip(" \t\r"):
                    out.append((file, start, line.removesuffix("\r"), None, first))
                    first = False
                continue
            pieces.append(line)
            if not inside:
                out.append((file, start, "\n".join(pieces).removesuffix("\r"), part, first and part is None))
                pieces, part, first = [], None, first and part is not None
        if out:
            yield _piece_batch(out)
    if pieces:
        yield _piece_batch([(*here, "\n".join(pieces), 1 if part == 0 else 2, first)])


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "start", "record", "part", "first"])


def csv_records(lines: DataFrame, tables: Scratch) -> DataFrame:
    """(record, first, whole): all records but blank ones; ``first``: the file's first one; ``whole`` is false for one whose last quote never closes."""
    begun = splits_begun_inside(lines).select(F.col("file").alias("f"), F.col("start").alias("s"), F.lit(True).alias("begun"))
    # No more rows than splits (one in maxPartitionBytes of input), 17 bytes each.
    begun = F.broadcast(tables.keep(begun))
    known = lines.join(begun, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")), "left")
    known = known.select("value", "file", "start", F.coalesce("begun", F.lit(False)).alias("begun"))
    cut = tables.keep(known.mapInArrow(_cut, "file bigint, start bigint, record string, part int, first boolean"))
    order = W.partitionBy("file").orderBy("start", "part")
    pieces = cut.where("part IS NOT NULL").withColumn("n", F.sum((F.col("part") == 2).cast("int")).over(order))
    joined = pieces.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("start", "part", "record"))).alias("p"), F.max("first").alias("first"))
    joined = joined.select(F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record"), "first", (F.element_at("p", -1)["part"] == 0).alias("whole"))
    return cut.where("part IS NULL").select("record", "first", F.lit(True).alias("whole")).unionByName(joined)
