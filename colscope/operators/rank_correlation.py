"""Spearman and Kendall matrices on pairwise-complete rows (C3, C4), from n x k shuffled rows instead of n x pairs.

Spearman.  Every column is sorted once.  A value's rank for a partner column counts only the rows in which the partner is present,
so the sort carries one counter per *presence class*: columns that are missing in the same rows share one, so do those without missing
values.  The sort is dealt into ranges on (column, value, row), so a value that fills a third of a column spreads over many tasks; what a
range lacks (rows before it, ties beyond its ends) is a few numbers per range.  Ranks go back to their rows in a second shuffle, where
each task sums the products of all pairs.  Both shuffles go in steps of a bounded number of cells (some columns, then some rows), whose
files are deleted before the next step; only the ranks inside ranges, as whole numbers by row, are kept for all cells.

Kendall's tau-b.  Columns are cut into strips of about equal row counts; a value heavy enough to fill a strip is a strip by itself.
Two rows in different strips of both columns are compared by counts of grid cells.  Rows that share a strip of one
column meet in that strip's task, which counts inversions for all partners at once.  Rows of a single-valued strip are tied, so
such strips need no task, however many rows they hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.scalar import col
from colscope.session import Scratch, brief_shuffles, small_scans

#: Aimed rows of a range or a strip, and the most of each.
RANGE_ROWS, MOST_RANGES = 250_000, 20_000
STRIP_ROWS, MOST_STRIPS = 100_000, 2_048
#: Cells of a file of the rows that are ranked, and bytes of files that a task reads (a file counts as 4 MB at least): a task that deals cells out keeps
#: all of its own in memory, so its share must not follow the input.
FILE_CELLS, SPLIT_BYTES = 1_000_000, 16 << 20
#: Aimed cells of one step's shuffle (about 25 bytes each on disk); a step takes one column at least.
STEP_CELLS = 200_000_000
#: Presence bits that one BIGINT holds.
_BITS = 60


# ---------------------------------------------------------------- Spearman

def presence_classes(missing: list[int], twins: dict[int, int] | None = None) -> list[int]:
    """Class of each column: 0 for columns without missing values, that of an earlier column for its twin, one of its own for every other."""
    classes, fresh = [], 0
    for i, m in enumerate(missing):
        if m and twins and i in twins:
            classes.append(classes[twins[i]])
            continue
        fresh += m > 0
        classes.append(fresh if m else 0)
    return classes


def _twins(rows: DataFrame, missing: list[int]) -> dict[int, int]:
    """Columns that are missing in the same rows as the first one with as many missing values."""
    first = {m: i for i, m in reversed(list(enumerate(missing)))}
    pairs = [(i, first[m]) for i, m in enumerate(missing) if m and first[m] < i]
    if not pairs:
        return {}
    apart = rows.agg(*(F.count_if(F.col(f"c{i}").isNull() != F.col(f"c{j}").isNull()) for i, j in pairs)).first()
    return {i: j for (i, j), n in zip(pairs, apart) if n == 0}


def _local_ranks(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """Rows of one range of (column, value) by row number, with twice their average ranks inside the range, one per class, and a mark (1: the
    column's first value in the range, 2: its last).

    Rows of kind 1 hold what other ranges need of a column: the first and last value, totals, and both values' ties.
    """
    table = pa.Table.from_batches(list(batches))
    n = table.num_rows
    if not n:
        return
    vi, v, rid = (table.column(c).to_numpy() for c in ("vi", "v", "rid"))
    order = np.lexsort((v, vi))
    vi, v, rid = vi[order], v[order], rid[order]
    bits = [table.column(f"has{w}").to_numpy()[order] for w in range(-(-classes // _BITS))]
    fresh = np.r_[True, (vi[1:] != vi[:-1]) | (v[1:] != v[:-1])]
    starts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    column = vi[starts]
    first_of = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
    last_of = np.r_[first_of[1:], len(column)] - 1
    sizes = last_of - first_of + 1
    marks = np.zeros(len(starts), np.int8)
    marks[last_of] = 2
    marks[first_of] = 1
    ranks, totals, first_ties, last_ties = [], [], [], []
    for c in range(classes):
        ties = np.add.reduceat((bits[c // _BITS] >> (c % _BITS)) & 1, starts)
        ends = np.cumsum(ties)
        begun = (ends - ties)[first_of]
        ranks.append((2 * (ends - ties - np.repeat(begun, sizes)) + ties + 1).astype(np.int32))
        totals.append((ends[last_of] - begun).astype(np.float64))
        first_ties.append(ties[first_of])
        last_ties.append(ties[last_of])
    part = TaskContext.get().partitionId()
    names = ["kind", "part", "vi", "rid", "mark", *(f"r{c}" for c in range(classes)), "edge"]

    def rows(kind, vi, rid, marks, values, edges):
        lead = [pa.array(np.full(len(vi), x, np.int32)) for x in (kind, part)]
        return pa.record_batch([*lead, pa.array(vi.astype(np.int32)), rid, pa.array(marks), *map(pa.array, values), edges], names)

    # In the order of the rows, numbers of rows and ranks of a column take a few bytes on disk.
    by_row = np.lexsort((rid, vi))
    for at in range(0, n, 50_000):
        cut = by_row[at:at + 50_000]
        g = group[cut]
        yield rows(0, vi[cut], pa.array(rid[cut]), marks[g], [r[g] for r in ranks], pa.nulls(len(g), pa.list_(pa.float64())))
    edges = [[v[starts[f]], v[starts[z]], *(t[k] for s in (totals, first_ties, last_ties) for t in s)] for k, (f, z) in enumerate(zip(first_of, last_of))]
    none = np.zeros(len(first_of), np.int32)
    yield rows(1, column[first_of], pa.nulls(len(first_of), pa.int64()), none.astype(np.int8), [none] * classes, pa.array(edges, pa.list_(pa.float64())))


def _range_offsets(edges: list, classes: int) -> tuple[list[tuple], dict]:
    """([(part, vi, offsets, ranks of the first value, of the last)], {vi: totals}) for every column of every range.

    ``edges``: at most ranges + columns rows.  A value at the end of a range may go on in others: its ranks are whole ones.
    """
    out, whole_columns = [], {}
    columns: dict[int, list] = {}
    for e in sorted(edges, key=lambda e: (e.vi, e.part)):
        columns.setdefault(e.vi, []).append(e)
    for vi, parts in columns.items():
        less: dict[float, np.ndarray] = {}
        ties: dict[float, np.ndarray] = {}
        seen = np.zeros(classes)
        for e in parts:
            low, high = e.edge[:2]
            totals, at_low, at_high = np.array(e.edge[2:]).reshape(3, classes)
            less.setdefault(low, seen)
            ties[low] = ties.get(low, 0) + at_low
            if high != low:
                less.setdefault(high, seen + totals - at_high)
                ties[high] = ties.get(high, 0) + at_high
            out.append([e.part, vi, seen.tolist(), low, high])
            seen = seen + totals
        whole_columns[vi] = seen
        for row in out[-len(parts):]:
            row[3:] = ((less[x] + (ties[x] + 1) / 2).tolist() for x in row[3:])
    return [tuple(r) for r in out], whole_columns


def _pair_products(batches: Iterator[pa.RecordBatch], classes: list[int], middle: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of squares and products of centred ranks over the task's rows (all columns of a row are in one task)."""
    k, width = len(classes), max(classes) + 1
    products, squares = np.zeros((k, k)), np.zeros((k, k))
    table = pa.Table.from_batches(list(batches), pa.schema([("rid", pa.int64()), ("vi", pa.int32()), *((f"r{c}", pa.float64()) for c in range(width))]))
    rid, vi = table.column("rid").to_numpy(), table.column("vi").to_numpy()
    ranks = np.stack([table.column(f"r{c}").to_numpy() for c in range(width)], axis=1)
    order = np.argsort(rid, kind="stable")
    row = np.cumsum(np.diff(rid[order], prepend=rid[order][:1]) != 0) if len(rid) else rid
    for at in range(0, int(row[-1]) + 1 if len(row) else 0, 2048):
        mine = slice(*np.searchsorted(row, [at, at + 2048]))
        cube = np.full((row[mine][-1] - at + 1, k, width), np.nan)
        cube[row[mine] - at, vi[order[mine]]] = ranks[order[mine]]
        centred = cube[:, :, classes] - middle
        there = ~np.isnan(cube[:, :, 0])
        centred[~(there[:, :, None] & there[:, None, :])] = 0.0
        products += np.einsum("rij,rji->ij", centred, centred)
        squares += np.einsum("rij,rij->ij", centred, centred)
    i, j = np.triu_indices(k, 1)
    yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(products[i, j]), pa.array(squares[i, j]), pa.array(squares[j, i])],
                          ["i", "j", "sab", "saa", "sbb"])


def spearman_sums(num: DataFrame, cols: list[str], missing: list[int]) -> DataFrame:
    """(i, j, n, sab, saa, sbb) for i < j: sums over the pair's complete rows of products of centred average ranks."""
    spark, k = num.sparkSession, len(cols)
    with Scratch() as tables, small_scans(spark, SPLIT_BYTES), brief_shuffles(spark):
        source = Scratch()
        rows = num.select(F.monotonically_increasing_id().alias("rid"), *(col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)))
        rows = source.keep(rows, max(1, FILE_CELLS // k), "zstd")
        total = rows.count()
        classes = presence_classes(missing, _twins(rows, missing))
        width = max(classes) + 1
        # One bit a class: the column that stands for it is there; class 0 is there in every row.
        present = [F.lit(True), *(F.col(f"c{classes.index(c)}").isNotNull() for c in range(1, width))]
        words = [sum((F.when(p, F.lit(1 << b)).otherwise(0) for b, p in enumerate(present[at:at + _BITS])), F.lit(0).cast("long")) for at in range(0, width, _BITS)]
        has = [w.alias(f"has{n}") for n, w in enumerate(words)]
        marks = [f"has{n}" for n in range(len(words))]

        def range_count(cells: int) -> int:
            return max(2 * spark.sparkContext.defaultParallelism, min(MOST_RANGES, math.ceil(cells / RANGE_ROWS)))

        kept = f"kind int, part int, vi int, rid long, mark tinyint, {', '.join(f'r{c} int' for c in range(width))}, edge array<double>"
        together, ranked = max(1, STEP_CELLS // max(1, total)), []
        for at in range(0, k, together):
            step = range(at, min(at + together, k))
            cells = F.explode(F.array(*(F.struct(F.lit(i).alias("vi"), F.col(f"c{i}").alias("v")) for i in step))).alias("e")
            long = rows.select("rid", *has, cells).select("e.vi", "e.v", "rid", *marks).where(F.col("v").isNotNull())
            # The row number parts equal values, so that one value may fill many ranges.
            found = long.repartitionByRange(range_count(total * len(step)), "vi", "v", "rid").mapInArrow(lambda it: _local_ranks(it, width), kept)
            ranked.append(tables.keep(found, compression="zstd"))
        source.drop()
        ranked = reduce(DataFrame.unionByName, ranked)
        offsets, totals = _range_offsets(ranked.where("kind = 1").collect(), width)
        n = np.array([totals.get(i, np.zeros(width))[classes] for i in range(k)])
        # At most ranges + columns rows; a column's ranges are all of one step, so their numbers are its own.
        offsets = spark.createDataFrame(offsets, "part int, vi int, off array<double>, at_low array<double>, at_high array<double>")

        def rank(c: int):
            return (F.when(F.col("mark") == 1, F.get("at_low", F.lit(c))).when(F.col("mark") == 2, F.get("at_high", F.lit(c)))
                    .otherwise(F.get("off", F.lit(c)) + F.col(f"r{c}") / 2)).alias(f"r{c}")

        steps, sums = max(1, math.ceil(total * k / STEP_CELLS)), {}
        for step in range(steps):
            mine = ranked.where("kind = 0")
            if steps > 1:
                mine = mine.where(F.pmod(F.xxhash64("rid"), F.lit(steps)) == step)
            back = mine.join(F.broadcast(offsets), ["part", "vi"]).select("rid", "vi", *(rank(c) for c in range(width)))
            back = back.repartition(range_count(math.ceil(total * k / steps)), "rid")
            found = back.mapInArrow(lambda it: _pair_products(it, classes, (n + 1) / 2), "i int, j int, sab double, saa double, sbb double")
            for s in found.groupBy("i", "j").agg(F.sum("sab").alias("sab"), F.sum("saa").alias("saa"), F.sum("sbb").alias("sbb")).collect():
                sums[s.i, s.j] = sums.get((s.i, s.j), np.zeros(3)) + [s.sab, s.saa, s.sbb]
    out = [(i, j, int(n[i, j]), *map(float, s)) for (i, j), s in sums.items() if n[i, j] > 0]
    return spark.createDataFrame(out, "i int, j int, n long, sab double, saa double, sbb double")


# ---------------------------------------------------------------- Kendall

#: Cells of all pairs' grids that a task counts at a time (4 bytes each).
_GRID_CELLS = 32_000_000


def strip_count(rows: int, columns: int) -> int:
    """Strips of a column: about ``STRIP_ROWS`` rows each, as far as the grids of all pairs stay within ``_GRID_CELLS``."""
    pairs = max(1, columns * (columns - 1) // 2)
    return max(2, min(MOST_STRIPS, int(math.sqrt(_GRID_CELLS / pairs) / 2), max(16, math.ceil(rows / STRIP_ROWS))))


def strips_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Strip of each value: 2 i + 1 for bound i itself, 2 i between the bounds below and above; -1 for a missing value."""
    at = np.searchsorted(bounds, values, side="left")
    exact = at < len(bounds)
    exact[exact] = bounds[at[exact]] == values[exact]
    return np.where(np.isnan(values), -1, 2 * at + exact)


def inversions(values: np.ndarray) -> int:
    """Pairs in which the earlier value is greater, counted bit by bit of the dense ranks (n log n, no loop over rows)."""
    ranks = np.unique(values, return_inverse=True)[1]
    total = 0
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        # Values that agree in all higher bits stand together, in their first order.
        ones = (ranks >> bit) & 1
        head = ranks >> (bit + 1)
        fresh = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
        before = np.cumsum(ones) - ones
        before -= np.repeat(before[fresh], np.diff(np.r_[fresh, len(head)]))
        total += int(before[ones == 0].sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return total


def _pairs_in(counts: np.ndarray) -> int:
    counts = counts.astype(np.int64)
    return int((counts * (counts - 1) // 2).sum())


def _equal_runs(*keys: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal keys in sorted order."""
    order = np.lexsort(keys)
    change = np.zeros(len(order), dtype=bool)
    change[:1] = True
    for key in keys:
        ordered = key[order]
        change[1:] |= ordered[1:] != ordered[:-1]
    return np.diff(np.r_[np.flatnonzero(change), len(order)])


def _matrix(batch, k: int) -> np.ndarray:
    columns = [batch.column(f"c{i}") for i in range(k)]
    return np.stack([c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in columns], axis=1).astype(np.float64)


def _grid_cells(batches: Iterator[pa.RecordBatch], bounds: list) -> Iterator[pa.RecordBatch]:
    """(i, j, cell, cnt): the task's rows by strips of both columns of every pair."""
    k = len(bounds)
    widths = [2 * len(b) + 1 for b in bounds]
    grids = {(i, j): np.zeros(widths[i] * widths[j], dtype=np.int64 if k < 4 else np.int32) for i in range(k) for j in range(i + 1, k)}
    for batch in batches:
        values = _matrix(batch, k)
        strips = [strips_of(values[:, i], bounds[i]) for i in range(k)]
        for (i, j), grid in grids.items():
            both = (strips[i] >= 0) & (strips[j] >= 0)
            cells, counts = np.unique(strips[i][both] * widths[j] + strips[j][both], return_counts=True)
            grid[cells] += counts.astype(grid.dtype)
    for (i, j), grid in grids.items():
        cells = np.flatnonzero(grid)
        size = len(cells)
        yield pa.record_batch([pa.array(np.full(size, i, np.int32)), pa.array(np.full(size, j, np.int32)), pa.array(cells.astype(np.int32)),
                               pa.array(grid[cells].astype(np.int64))], ["i", "j", "cell", "cnt"])


_SUMS = "i int, j int, n double, d double, n1 double, n2 double, n3 double"


def _sums(rows: list[tuple]) -> pa.Table:
    kinds = [("i", pa.int32()), ("j", pa.int32()), *((c, pa.float64()) for c in ("n", "d", "n1", "n2", "n3"))]
    return pa.table([pa.array([r[c] for r in rows], t) for c, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))


def _grid_sums(cells: pa.Table, bounds: list) -> pa.Table:
    """Of one pair: rows, discordant pairs in different strips of both columns, ties of single-valued strips."""
    i, j = cells.column("i")[0].as_py(), cells.column("j")[0].as_py()
    grid = np.zeros((2 * len(bounds[i]) + 1, 2 * len(bounds[j]) + 1), dtype=np.int64)
    grid.flat[cells.column("cell").to_numpy()] = cells.column("cnt").to_numpy()
    # Rows in smaller strips of the first column and greater ones of the second.
    beyond = np.zeros_like(grid)
    beyond[1:, :-1] = np.cumsum(np.cumsum(grid[:, ::-1], axis=1)[:, ::-1], axis=0)[:-1, 1:]
    discordant = (grid.astype(np.float64) * beyond).sum()
    return _sums([(i, j, float(grid.sum()), float(discordant), *(float(_pairs_in(c)) for c in (
        grid[1::2].sum(axis=1), grid[:, 1::2].sum(axis=0), grid[1::2, 1::2].ravel())))])


def _strip_rows(batches: Iterator[pa.RecordBatch], bounds: list) -> Iterator[pa.RecordBatch]:
    """Every row once for each of its columns whose strip is not single-valued: (i, strip, all values)."""
    k = len(bounds)
    for batch in batches:
        values = _matrix(batch, k)
        for i in range(k):
            strips = strips_of(values[:, i], bounds[i])
            mine = (strips >= 0) & (strips % 2 == 0)
            columns = [pa.array(np.full(int(mine.sum()), i, np.int32)), pa.array(strips[mine].astype(np.int32))]
            yield pa.record_batch([*columns, *(pa.array(values[mine, c], from_pandas=True) for c in range(k))], ["i", "strip", *(f"c{c}" for c in range(k))])


def _strip_sums(rows: pa.Table, bounds: list) -> pa.Table:
    """Of one strip of column i: what the pairs of rows inside it add to every pair (i, j)."""
    i, k = rows.column("i")[0].as_py(), len(bounds)
    values, out = _matrix(rows, k), []
    for j in range(k):
        both = ~np.isnan(values[:, j])
        if j == i or not both.any():
            continue
        own, other = values[both, i], values[both, j]
        tied = float(_pairs_in(_equal_runs(own)))
        if i < j:
            found = inversions(other[np.lexsort((other, own))])
            out.append((i, j, 0.0, float(found), tied, 0.0, float(_pairs_in(_equal_runs(own, other)))))
        else:
            # Rows that also share a strip of the first column were compared there, unless all its values are one.
            strips = strips_of(other, bounds[j])
            found = inversions(own[np.lexsort((own, strips))])
            single = strips % 2 == 1
            out.append((j, i, 0.0, float(found), 0.0, tied, float(_pairs_in(_equal_runs(own[single], strips[single])))))
    return _sums(out)


def kendall_sums(num: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, d, n1, n2, n3) for i < j: rows, discordant pairs, and pairs tied in i, in j, in both, on the pair's complete rows."""
    k = len(cols)
    with Scratch() as tables:
        rows = tables.keep(num.select(*(col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols))))
        strips = strip_count(rows.count(), k)
        shares = [s / strips for s in range(1, strips)]
        cuts = rows.agg(*(F.percentile_approx(f"c{i}", shares, max(10_000, 20 * strips)) for i in range(k))).first()
        bounds = [np.unique(np.array(c or [], dtype=np.float64)) for c in cuts]
        cells = rows.mapInArrow(lambda it: _grid_cells(it, bounds), "i int, j int, cell int, cnt long")
        cells = cells.groupBy("i", "j", "cell").agg(F.sum("cnt").alias("cnt"))
        apart = cells.groupBy("i", "j").applyInArrow(lambda t: _grid_sums(t, bounds), _SUMS)
        spread = ", ".join(f"c{c} double" for c in range(k))
        inside = rows.mapInArrow(lambda it: _strip_rows(it, bounds), f"i int, strip int, {spread}").groupBy("i", "strip").applyInArrow(
            lambda t: _strip_sums(t, bounds), _SUMS)
        found = apart.unionByName(inside).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "d", "n1", "n2", "n3"))).collect()
    return num.sparkSession.createDataFrame([(f.i, f.j, int(f.n), f.d, f.n1, f.n2, f.n3) for f in found], _SUMS.replace("n double", "n long", 1))
