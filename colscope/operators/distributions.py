"""Histograms.

Edges are computed on the driver from per-column (min, max, distinct) — a
handful of numbers per column — and enter the plan as literals; the counting
itself is one Spark aggregate over the whole table.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.scalar import col, finite_double

RIGHT_CLOSED_MAX_BINS = 5   # profile detail histogram
LEFT_CLOSED_MAX_BINS = 10   # report chart histogram
EDGE_ADJUST = 0.001         # 0.1 % of the range, or of |value| for one value
LABEL_PRECISION = 3


def linspace(start: float, stop: float, num: int) -> list[float]:
    """Evenly spaced edges, computed as i * step + start, last edge exactly ``stop``."""
    div = num - 1
    step = (stop - start) / div
    out = [i * step + start for i in range(num)]
    out[-1] = stop
    return out


def right_closed_edges(mn: float, mx: float, distinct: int, max_bins: int = RIGHT_CLOSED_MAX_BINS) -> list[float]:
    """Edges of ``bins`` equal intervals (a, b]; first edge lowered by 0.1 % of the range."""
    bins = min(max_bins, max(1, distinct))
    if mn == mx:
        lo = mn - (EDGE_ADJUST * abs(mn) if mn != 0 else EDGE_ADJUST)
        hi = mx + (EDGE_ADJUST * abs(mx) if mx != 0 else EDGE_ADJUST)
        return linspace(lo, hi, bins + 1)
    edges = linspace(mn, mx, bins + 1)
    edges[0] -= (mx - mn) * EDGE_ADJUST
    return edges


def left_closed_edges(mn: float, mx: float, distinct: int, max_bins: int = LEFT_CLOSED_MAX_BINS) -> list[float]:
    """Edges of [a, b) intervals, last one closed; one value -> range widened by 0.5 each side."""
    bins = min(max_bins, max(1, distinct))
    if mn == mx:
        mn, mx = mn - 0.5, mx + 0.5
    return linspace(mn, mx, bins + 1)


def label_number(x: float, precision: int) -> float:
    """An edge as its label shows it: ``precision`` decimals, or below 1 as many significant digits."""
    if x == 0 or not math.isfinite(x):
        return x
    # Place of the first significant digit: 0 for units, -1 for tenths, ...
    first = min(0, Decimal(repr(x)).adjusted() + 1)
    return round(x, precision - first)


def interval_labels(edges: list[float], precision: int = LABEL_PRECISION) -> list[str]:
    """Text labels ``(a, b]`` with the smallest precision >= 3 that keeps edges distinct."""
    tried = ([label_number(e, p) for e in edges] for p in range(precision, 20))
    shown = next((t for t in tried if len(set(t)) == len(t)), [label_number(e, precision) for e in edges])
    return [f"({float(low)}, {float(high)}]" for low, high in zip(shown, shown[1:])]


# Exact distinct counts are needed only up to the bin cap (10).  A column with n <= 10 values sets at most n of the
# sketch's 512 registers, so its estimate is 10.1 at most: none that is estimated at 100 or more can be below the cap.
_EXACT_BELOW = 100
#: Columns of one aggregate.
_BATCH = 16


def numeric_range_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """(min, max, distinct-or-at-least-100) per numeric column.

    Aggregates without a grouping key give min, max and an estimate of the distinct count; only columns estimated below
    100 distinct values get an exact count (their value-count table is tiny), so no full distinct shuffle.
    """
    if not columns:
        return {}
    dtypes = dict((f.name, f.dataType) for f in df.schema.fields)
    rows = []
    for start in range(0, len(columns), _BATCH):
        batch = list(enumerate(columns))[start:start + _BATCH]
        values = df.select(*(finite_double(col(c), dtypes[c]).alias(f"v{i}") for i, c in batch))
        row = values.agg(*(F.struct(F.lit(i).alias("vi"), F.min(f"v{i}").alias("mn"), F.max(f"v{i}").alias("mx"),
                                    F.approx_count_distinct(f"v{i}").alias("nd")) for i, _ in batch)).first()
        rows += [r for r in row if r["mn"] is not None]
    out = {c: (None, None, 0) for c in columns}
    small = []
    for r in rows:
        out[columns[r["vi"]]] = (r["mn"], r["mx"], max(int(r["nd"]), _EXACT_BELOW))
        if r["nd"] < _EXACT_BELOW:
            small.append(r["vi"])
    if small:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("vi"), finite_double(col(columns[i]), dtypes[columns[i]]).alias("v"))
                                             for i in small))).alias("e")).select("e.*").where(F.col("v").isNotNull())
        exact = (long.groupBy("vi", "v").agg(F.count(F.lit(1)).alias("c"))
                 .groupBy("vi").agg(F.count(F.lit(1)).alias("nd")).collect())
        for r in exact:
            mn, mx, _ = out[columns[r["vi"]]]
            out[columns[r["vi"]]] = (mn, mx, int(r["nd"]))
    return out


def _padded(edges: list[float], width: int) -> list[float]:
    return list(edges) + [float("inf")] * (width - len(edges))


def histogram_counts(df: DataFrame, specs: dict[str, list[float]], right_closed: bool = True,
                     fences: dict[str, tuple[float, float]] | None = None) -> dict[str, list[int]]:
    """Bin counts for many columns at once; empty bins kept as 0.

    Rows are exploded to (column, value) first, then binned by one short
    expression over that column's edge list (see :func:`binned_counts`).
    ``fences`` (optional, {column: (lower, upper)}) adds, in the same pass,
    the count of values outside them under key ``"<column>#outliers"``.
    """
    fences = fences or {}
    names = list(dict.fromkeys(list(specs) + list(fences)))
    if not names:
        return {}
    dtypes = dict((f.name, f.dataType) for f in df.schema.fields)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("vi"), finite_double(col(c), dtypes[c]).alias("v"))
        for i, c in enumerate(names)
    ])).alias("e")).select("e.*").where(F.col("v").isNotNull())
    return binned_counts(long, names, specs, right_closed, fences)


def binned_counts(long: DataFrame, names: list[str], specs: dict[str, list[float]], right_closed: bool = True,
                  fences: dict[str, tuple[float, float]] | None = None, weight: str | None = None) -> dict:
    """Bin and outlier counts from (vi, v[, weight]) rows, ``vi`` indexing ``names``.

    A value's bin is ``1 + sum(v > e_i)`` over its column's inner edges
    (``>=`` for left-closed bins), edge lists padded with +inf, so the code
    stays small whatever the number of columns or bins; map-side partial
    counts leave at most columns x bins rows per task for the shuffle.  With
    ``weight`` (e.g. a value-count table) each row counts that many times.
    """
    fences = fences or {}
    width = max([len(specs[c]) for c in names if c in specs] + [2])
    table = F.array(*[F.array(*[F.lit(float(x)) for x in _padded(specs.get(c, []), width)]) for c in names])
    inf = float("inf")
    lo_t = F.array(*[F.lit(float(fences[c][0]) if c in fences else -inf) for c in names])
    hi_t = F.array(*[F.lit(float(fences[c][1]) if c in fences else inf) for c in names])
    edges = F.element_at(table, F.col("vi") + 1)
    v = F.col("v")
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    bin_ = F.lit(1)
    for i in range(1, width - 1):
        cond = (v > F.element_at(edges, i + 1)) if right_closed else (v >= F.element_at(edges, i + 1))
        bin_ = bin_ + cond.cast("int")
    first = F.element_at(edges, 1)
    inside = (v > first) if right_closed else (v >= first)
    bin_ = F.when(inside, bin_).otherwise(F.lit(0))
    outside = (v < F.element_at(lo_t, F.col("vi") + 1)) | (v > F.element_at(hi_t, F.col("vi") + 1))
    grouped = long.select("vi", bin_.alias("bin"), w.alias("w"), F.when(outside, w).otherwise(0).alias("out")) \
        .groupBy("vi", "bin").agg(F.sum("w").alias("cnt"), F.sum("out").alias("out"))
    got, outl = {}, {}
    for r in grouped.collect():
        got[(r["vi"], r["bin"])] = r["cnt"]
        outl[r["vi"]] = outl.get(r["vi"], 0) + int(r["out"])
    out = {}
    for i, c in enumerate(names):
        if c in specs:
            n = len(specs[c]) - 1
            counts = [int(got.get((i, j), 0)) for j in range(1, n + 1)]
            if not right_closed:
                # numpy: the last bin is closed on the right, so the maximum lands in it
                counts[-1] += int(got.get((i, n + 1), 0))
            out[c] = counts
        if c in fences:
            out[c + "#outliers"] = outl.get(i, 0)
    return out


def histogram_frame(df: DataFrame, columns: list[str], right_closed: bool = True) -> DataFrame:
    """Long histogram table: (variable, bin, lower, upper, label, count)."""
    stats = numeric_range_stats(df, columns)
    specs = {}
    for c in columns:
        mn, mx, nd = stats[c]
        if mn is None:
            continue
        specs[c] = right_closed_edges(mn, mx, nd) if right_closed else left_closed_edges(mn, mx, nd)
    counts = histogram_counts(df, specs, right_closed)
    rows = []
    for c, edges in specs.items():
        labels = interval_labels(edges) if right_closed else [
            f"[{edges[i]}, {edges[i + 1]}{']' if i == len(edges) - 2 else ')'}" for i in range(len(edges) - 1)
        ]
        for j, cnt in enumerate(counts[c], start=1):
            rows.append((c, j, float(edges[j - 1]), float(edges[j]), labels[j - 1], int(cnt)))
    schema = "variable string, bin int, lower double, upper double, label string, count long"
    return df.sparkSession.createDataFrame(rows, schema)
