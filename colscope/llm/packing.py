"""Best-fit packing of tokenised documents by exact-complement hashing.

1. Every task tokenises its documents, cuts them into pieces of at most ``capacity`` ids and
   numbers the pieces of each length as it writes them: (task, length, rank).  The table is
   materialised, so these numbers never change, and no shuffle is needed for them.
2. The plan depends on the histogram of lengths only (``capacity`` numbers, whatever the size of
   the corpus).  From the longest length down, the gap that a piece leaves is looked
   up among the sums of one, two and three available lengths, and a combination that fills it
   exactly is consumed as often as its counts allow; what finds no exact filling is placed
   by best fit, longest first.
3. A piece finds its place by its length and its rank among all pieces of that length; a hot length is only
   a range of ranks, never a group.

Defined results: NULL text counts as empty (its sequence holds the end id alone); rows that
repeat or share a doc_id are packed each on its own; NULL doc_id stays NULL; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.llm import bpe
from colscope.llm.common import id_and_text, release_memory, task_number, text_chunks
from colscope.session import reliable_checkpoint

#: Offsets of (task, length) are broadcast up to this many rows (24 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids binary, task int, rank long"


def _pieces(batches: Iterator[pa.RecordBatch], spec: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    model, task = bpe.load(spec), task_number()
    ranks = [0] * (capacity + 1)
    for keys, texts in text_chunks(batches):
        columns: list[list] = [[] for _ in range(6)]
        for key, text in zip(keys, texts):
            ids = np.append(model.ids(text), np.uint32(end_id)).astype("<u4")
            first = len(ids) % capacity or min(len(ids), capacity)
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for column, value in zip(columns, (key, piece, a, b - a, ids[a:b].tobytes(), ranks[b - a])):
                    column.append(value)
                ranks[b - a] += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        doc_id, piece, start, length, ids, rank = (pa.array(c, k) for c, k in zip(columns, kinds))
        yield pa.record_batch([doc_id, piece, start, length, ids, pa.array([task] * len(rank), pa.int32()), rank],
                              ["doc_id", "piece", "start", "length", "ids", "task", "rank"])
    release_memory()


def _bits(lengths: list[int]) -> int:
    out = 0
    for n in lengths:
        out |= 1 << n
    return out


class _Sums:
    """Which sums one, two or three available lengths reach, as bit sets; rebuilt when a length runs out."""

    def __init__(self, counts: list[int], capacity: int) -> None:
        self.counts, self.mask = counts, (1 << (capacity + 1)) - 1
        self.refresh()

    def refresh(self) -> None:
        self.lengths = [n for n in range(1, len(self.counts)) if self.counts[n]]
        self.one, self.two, self.three = _bits(self.lengths), 0, 0
        for n in self.lengths:
            self.two |= self.one << n
        self.two &= self.mask
        for n in self.lengths:
            self.three |= self.two << n
        self.three &= self.mask

    def _allowed(self, *lengths: int) -> bool:
        return all(self.counts[n] >= lengths.count(n) for n in set(lengths))

    def filling(self, longest: int, gap: int) -> tuple[int, ...] | None:
        """Up to three lengths that fill the gap beside ``longest``, the longest first."""
        if self.one >> gap & 1 and self._allowed(longest, gap):
            return (gap,)
        if self.two >> gap & 1 and (pair := self._pair(gap, gap, (longest,))):
            return pair
        if self.three >> gap & 1:
            for a in reversed(self.lengths):
                if a < gap and 3 * a >= gap and self.two >> (gap - a) & 1 and (pair := self._pair(gap - a, a, (longest, a))):
                    return (a, *pair)
        return None

    def _pair(self, total: int, most: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        for a in range(min(most, total - 1), (total - 1) // 2, -1):
            if self.counts[a] and self.counts[total - a] and self._allowed(*beside, a, total - a):
                return a, total - a
        return None


def plan_packing(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences) for ``counts[n]`` pieces of length n; few thousand entries at any corpus size."""
    counts = list(counts)
    plan: list[tuple[tuple[int, ...], int]] = []
    sums = _Sums(counts, capacity)
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            filling = (() if longest == capacity else sums.filling(longest, capacity - longest))
            if filling is None:
                break
            lengths = (longest, *filling)
            times = min(counts[n] // lengths.count(n) for n in set(lengths))
            plan.append((lengths, times))
            for n in lengths:
                counts[n] -= times
            if not all(counts[n] for n in lengths):
                sums.refresh()
    gaps: dict[int, list[list]] = {}  # free room: [lengths, number of open sequences]
    for n in range(capacity, 0, -1):
        while counts[n]:
            room = min((g for g in gaps if g >= n and gaps[g]), default=None)
            if room is None:
                fit = capacity // n
                for lengths, times in (((n,) * fit, counts[n] // fit), ((n,) * (counts[n] % fit), 1)):
                    if lengths and times:
                        gaps.setdefault(capacity - n * len(lengths), []).append([lengths, times])
                counts[n] = 0
                continue
            entry = gaps[room][-1]
            times = min(entry[1], counts[n])
            entry[1] -= times
            if not entry[1]:
                gaps[room].pop()
            gaps.setdefault(room - n, []).append([(*entry[0], n), times])
            counts[n] -= times
    return plan + [(lengths, times) for entries in gaps.values() for lengths, times in entries]


def _segments(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset): where ranks of a length go."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            first = used.get(n, 0)
            out.append((n, first, first + times - 1, sequence, offset))
            used[n], offset = first + times, offset + n
        sequence += times
    return out


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with length, task, rank) plus sequence_id and offset."""
    spark: SparkSession = pieces.sparkSession
    groups = reliable_checkpoint(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = [0] * (capacity + 1)
    n_groups = 0
    for row in groups.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tasks")).collect():
        counts[row["length"]] = row["n"]
        n_groups += row["tasks"]
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = groups.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    segments = _segments(plan_packing(counts, capacity)) or [(0, 0, 0, 0, 0)]
    places = spark.createDataFrame(segments, "length int, _from long, _to long, _sequence long, _offset long")
    ranked = pieces.join(F.broadcast(first) if n_groups <= BROADCAST_ROWS else first, ["task", "length"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("rank"))
    return (ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & F.col("_rank").between(F.col("_from"), F.col("_to")))
            .select(*(ranked[c] for c in pieces.columns if c not in ("task", "rank")),
                    (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset")))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    spec = bpe.read_spec(path)
    cut = id_and_text(docs, key, text).mapInArrow(lambda it: _pieces(it, spec, capacity, end_id), _PIECE_SCHEMA)
    return place_pieces(reliable_checkpoint(cut), capacity)


def piece_digests(packed: DataFrame) -> DataFrame:
    """The contract's columns; the ids as their checksum."""
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
