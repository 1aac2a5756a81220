"""Column profile in a fixed number of passes.

pass 1  wide aggregates per batch of 16 columns: rows, nulls, min/max/mean/std
pass 2  without details: exact quartiles from sketched brackets; with details one value-count table
        of all numeric columns (distributed ranks): exact quartiles, distinct counts and top-5 values
pass 3  parse counts of text columns (X1); for the details value frequencies of the other columns by hash
pass 4  IQR outlier counts as one aggregate; for the details read off the materialised count table of pass 2, with the
        histogram bins; fences and edges are literals

Each pass returns a few numbers per column; the profile tables are built from
those (their size is bounded by the number of columns, not rows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.scalar import (
    CATEGORICAL, NOT_AVAILABLE, NUMERIC, TEMPORAL, as_text, col, finite_double,
    is_numeric_type, null_or_nan,
)
from colscope.operators.distributions import (
    binned_counts, interval_labels, right_closed_edges,
)
from colscope.operators.frequencies import frequency_summary
from colscope.operators.ranks import range_tag, running_before, running_before_tagged
from colscope.operators.semtypes import kind_of, parse_counts
from colscope.session import Scratch

QUARTILES = [0.25, 0.5, 0.75]
IQR_FACTOR = 1.5
TOP_K = 5

# Labels of the detail panel statistics.
LABEL_MIN = "Mínimo"
LABEL_MAX = "Máximo"
LABEL_MEAN = "Promedio"
LABEL_MEDIAN = "Mediana"
LABEL_STD = "Desv. estándar"
LABEL_QUARTILES = "Cuartiles"
LABEL_DISTINCT = "Valores únicos"
LABEL_MODE = "Más frecuente"
LABEL_NULLS = "Nulos"

VARIABLES_SCHEMA = (
    "ordinal int, variable string, variable_type string, valid long, nulls long, "
    "q1 double, q2 double, q3 double, outliers long"
)
SUMMARY_SCHEMA = (
    "rows long, variables int, completeness double, null_cells long, outliers long, "
    "numeric int, categorical int, temporal int"
)
DETAILS_SCHEMA = (
    "ordinal int, variable string, variable_type string, valid long, nulls long, "
    "stats array<struct<label:string,value:string>>, "
    "distribution array<struct<range:string,count:long>>, "
    "percentages array<struct<range:string,percent:double>>"
)


@dataclass
class VariableProfile:
    ordinal: int
    name: str
    dtype: T.DataType
    kind: str = CATEGORICAL
    valid: int = 0
    nulls: int = 0
    minimum: float | None = None
    maximum: float | None = None
    mean: float | None = None
    std: float | None = None
    n_numeric: int = 0
    quartiles: tuple = (None, None, None)
    outliers: int | None = None
    distinct: int = 0
    top: list = field(default_factory=list)
    histogram: list = field(default_factory=list)


def format_es(value, integral: bool = False) -> str:
    """thousands '.', decimals ',' with 2 places; whole-number types as is; null -> N/D."""
    if value is None:
        return NOT_AVAILABLE
    if integral:
        return str(int(value))
    text = f"{float(value):,.2f}"
    return text.translate(str.maketrans({",": ".", ".": ","}))


def _is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


class Profile:
    """Profile of one table; build with :func:`profile`."""

    def __init__(self, spark, rows: int, variables: list[VariableProfile]):
        self.spark = spark
        self.rows = rows
        self.variables = variables

    # X2
    def variables_frame(self) -> DataFrame:
        data = [
            (v.ordinal, v.name, v.kind, v.valid, v.nulls,
             *(float(q) if q is not None else None for q in v.quartiles), v.outliers)
            for v in self.variables
        ]
        return self.spark.createDataFrame(data, VARIABLES_SCHEMA)

    # X3
    def summary_row(self) -> dict:
        cells = self.rows * len(self.variables)
        null_cells = sum(v.nulls for v in self.variables)
        completeness = 100.0 if cells == 0 else round((cells - null_cells) / cells * 100, 1)
        return {
            "rows": self.rows,
            "variables": len(self.variables),
            "completeness": completeness,
            "null_cells": null_cells,
            "outliers": sum(v.outliers or 0 for v in self.variables),
            "numeric": sum(v.kind == NUMERIC for v in self.variables),
            "categorical": sum(v.kind == CATEGORICAL for v in self.variables),
            "temporal": sum(v.kind == TEMPORAL for v in self.variables),
        }

    def summary_frame(self) -> DataFrame:
        s = self.summary_row()
        return self.spark.createDataFrame([tuple(s.values())], SUMMARY_SCHEMA)

    # X4
    def detail(self, v: VariableProfile) -> dict:
        if v.kind == NUMERIC:
            integral = _is_integral(v.dtype)
            q1, _, q3 = v.quartiles
            std = v.std if v.n_numeric > 1 else 0
            stats = [
                (LABEL_MIN, format_es(v.minimum, integral)),
                (LABEL_MAX, format_es(v.maximum, integral)),
                (LABEL_MEAN, format_es(v.mean)),
                (LABEL_MEDIAN, format_es(v.quartiles[1])),
                (LABEL_STD, "0" if v.n_numeric <= 1 else format_es(std)),
                (LABEL_QUARTILES, f"Q1 {format_es(q1)} · Q3 {format_es(q3)}"),
            ]
            distribution = list(v.histogram)
        else:
            stats = [
                (LABEL_DISTINCT, str(v.distinct)),
                (LABEL_MODE, v.top[0][0] if v.top else NOT_AVAILABLE),
                (LABEL_NULLS, str(v.nulls)),
            ]
            distribution = [(value, cnt) for value, cnt in v.top]
        percentages = [(value, round(cnt / v.valid * 100, 1)) for value, cnt in v.top] if v.valid else []
        return {
            "ordinal": v.ordinal, "variable": v.name, "variable_type": v.kind,
            "valid": v.valid, "nulls": v.nulls, "stats": stats,
            "distribution": distribution, "percentages": percentages,
        }

    def details_frame(self) -> DataFrame:
        rows = [tuple(self.detail(v).values()) for v in self.variables]
        return self.spark.createDataFrame(rows, DETAILS_SCHEMA)

    def numeric_stats_frame(self) -> DataFrame:
        """A10 as numbers: min, max, mean, median, std (0 for one value) per numeric column."""
        data = [
            (v.ordinal, v.name,
             *(None if x is None else float(x) for x in (v.minimum, v.maximum, v.mean, v.quartiles[1])),
             None if v.n_numeric == 0 else float(v.std if v.n_numeric > 1 else 0.0))
            for v in self.variables if v.kind == NUMERIC
        ]
        schema = "ordinal int, variable string, min double, max double, mean double, median double, std double"
        return self.spark.createDataFrame(data, schema)


BATCH = 16


def _pass1(df: DataFrame, vars_: list[VariableProfile]) -> int:
    """Rows, null counts and min/max/mean/std of every column.

    Wide aggregates over batches of 16 columns: each batch reads only its own
    columns from a columnar source (so every column is read once overall),
    and the generated code per batch stays small however wide the table is.
    """
    rows = None
    for start in range(0, max(len(vars_), 1), BATCH):
        chunk = vars_[start:start + BATCH]
        exprs = [F.count(F.lit(1)).alias("__rows")]
        for v in chunk:
            c, i = col(v.name), v.ordinal
            exprs.append(F.count_if(null_or_nan(c, v.dtype)).alias(f"nulls{i}"))
            if is_numeric_type(v.dtype):
                d = finite_double(c, v.dtype)
                # Whole numbers beyond 2^53 keep all their digits.
                ends = c if _is_integral(v.dtype) else d
                exprs += [F.min(ends).alias(f"min{i}"), F.max(ends).alias(f"max{i}"), F.avg(d).alias(f"avg{i}"),
                          F.stddev_samp(d).alias(f"std{i}"), F.count(d).alias(f"nnum{i}")]
        r = df.agg(*exprs).first()
        rows = r["__rows"]
        for v in chunk:
            i = v.ordinal
            v.nulls = int(r[f"nulls{i}"])
            v.kind = kind_of(v.dtype, None)
            if is_numeric_type(v.dtype):
                v.minimum, v.maximum = r[f"min{i}"], r[f"max{i}"]
                v.mean, v.std, v.n_numeric = r[f"avg{i}"], r[f"std{i}"], r[f"nnum{i}"]
    rows = rows or 0
    for v in vars_:
        v.valid = rows - v.nulls
    return rows


def _numeric_pass(df: DataFrame, numeric: list[VariableProfile], tables: Scratch) -> DataFrame | None:
    """Pass 2: one value-count table of all numeric columns feeds, in one query,
    the exact quartiles, the distinct counts and the top-5 values.

    The count table (column, value, text, count) is range-partitioned and
    checkpointed by ``running_before``; quartile targets, distinct counts and
    top-k rows are read off it in one union query (bounded result).
    """
    if not numeric:
        return
    text = [as_text(col(v.name), v.dtype) for v in numeric]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("vi"), finite_double(col(v.name), v.dtype).alias("v"), text[i].alias("t"))
        for i, v in enumerate(numeric)
    ])).alias("e")).select("e.*").where(F.col("v").isNotNull())
    # the text form (needed only for the top-5 table) is a grouping key, not an
    # aggregate: hash aggregation stays available, 64-bit integers keep exact text
    counts = long.groupBy("vi", "v", "t").agg(F.count(F.lit(1)).alias("cnt"))
    tagged = range_tag(counts, ["vi"], "v", tables=tables)
    ranked = running_before_tagged(tagged, ["vi"], "v", "cnt", total="n")
    pos = F.col("n") - 1
    targets = F.array(*[
        F.struct(F.lit(qi).alias("q"), F.floor(pos * F.lit(p)).cast("long").alias("lo"),
                 F.least(F.ceil(pos * F.lit(p)).cast("long"), pos).alias("hi"),
                 (pos * F.lit(p) - F.floor(pos * F.lit(p))).alias("f"))
        for qi, p in enumerate(QUARTILES)
    ])
    start, end = F.col("before"), F.col("before") + F.col("cnt")
    in_lo = (F.col("t.lo") >= start) & (F.col("t.lo") < end)
    in_hi = (F.col("t.hi") >= start) & (F.col("t.hi") < end)
    hits = ranked.select("vi", "v", "before", "cnt", F.explode(targets).alias("t")).where(in_lo | in_hi).select(
        F.lit(1).alias("kind"), "vi", F.col("t.q").alias("pos"),
        F.when(in_lo, F.col("v")).alias("a"), F.when(in_hi, F.col("v")).alias("b"),
        F.col("t.f").alias("f"), F.lit(None).cast("string").alias("value"), F.col("cnt"))
    parts = [hits]
    w = Window.partitionBy("vi").orderBy(F.col("cnt").desc(), F.col("t").asc())
    parts.append(tagged.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= TOP_K).select(
        F.lit(2).alias("kind"), "vi", "pos", F.lit(None).cast("double").alias("a"),
        F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("f"),
        F.col("t").alias("value"), "cnt"))
    parts.append(tagged.groupBy("vi").agg(F.count(F.lit(1)).alias("cnt")).select(
        F.lit(3).alias("kind"), "vi", F.lit(0).alias("pos"), F.lit(None).cast("double").alias("a"),
        F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("f"),
        F.lit(None).cast("string").alias("value"), "cnt"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    got: dict = {}
    for r in union.collect():
        v = numeric[r["vi"]]
        if r["kind"] == 1:
            slot = got.setdefault((r["vi"], r["pos"]), [None, None, r["f"]])
            if r["a"] is not None:
                slot[0] = r["a"]
            if r["b"] is not None:
                slot[1] = r["b"]
        elif r["kind"] == 2:
            v.top.append((r["pos"], r["value"], int(r["cnt"])))
        else:
            v.distinct = int(r["cnt"])
    for i, v in enumerate(numeric):
        v.top = [(val, c) for _, val, c in sorted(v.top)]
        v.quartiles = tuple(_lerp(*got[(i, qi)]) if (i, qi) in got else None for qi in range(len(QUARTILES)))
    return tagged


def _lerp(a: float, b: float, t: float) -> float:
    """numpy's linear interpolation between neighbours a and b at fraction t."""
    if t == 0:
        return a
    if t < 0.5:
        return a + t * (b - a)
    return b - (b - a) * (1 - t)


def fences(q1: float, q3: float) -> tuple[float, float] | None:
    """(lower, upper) IQR fences; None when IQR is 0 (no outliers by rule A8)."""
    iqr = q3 - q1
    if iqr == 0:
        return None
    return q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr


def _pass4_from_counts(counts: DataFrame, numeric: list[VariableProfile]) -> None:
    """Outliers (A8) and histograms (A13) from the materialised value-count table
    of pass 2: work proportional to distinct values, no second scan of the data."""
    specs, fence = {}, {}
    for v in numeric:
        q1, _, q3 = v.quartiles
        f = fences(q1, q3) if q1 is not None else None
        if f is not None:
            fence[v.name] = f
        if v.minimum is not None and v.n_numeric:
            specs[v.name] = right_closed_edges(float(v.minimum), float(v.maximum), v.distinct)
    names = [v.name for v in numeric]
    got = binned_counts(counts.select("vi", "v", "cnt"), names, specs, True, fence, weight="cnt")
    for v in numeric:
        v.outliers = int(got.get(v.name + "#outliers", 0))
        if v.name in specs:
            v.histogram = list(zip(interval_labels(specs[v.name]), got[v.name]))


def _fence_counts(df: DataFrame, numeric: list[VariableProfile]) -> None:
    """Outlier counts (A8) as wide aggregates per batch; the fences are literals."""
    for start in range(0, len(numeric), BATCH):
        chunk, exprs = numeric[start:start + BATCH], []
        for v in chunk:
            d, bounds = finite_double(col(v.name), v.dtype), fences(v.quartiles[0], v.quartiles[2]) if v.quartiles[0] is not None else None
            exprs.append((F.count_if((d < bounds[0]) | (d > bounds[1])) if bounds else F.lit(0).cast("long")).alias(f"out{v.ordinal}"))
        r = df.agg(F.count(F.lit(1)), *exprs).first()
        for v in chunk:
            v.outliers = int(r[f"out{v.ordinal}"])


def _approx_quartiles(df: DataFrame, numeric: list[VariableProfile], accuracy: int) -> None:
    """Quartiles from ``percentile_approx`` sketches: one pass, fixed memory per column,
    no shuffle of distinct values (rank error about n / accuracy; values are data
    points, not interpolated)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("vi"), finite_double(col(v.name), v.dtype).alias("v"))
        for i, v in enumerate(numeric)
    ])).alias("e")).select("e.*").where(F.col("v").isNotNull())
    got = {r["vi"]: r["q"] for r in long.groupBy("vi").agg(
        F.percentile_approx("v", QUARTILES, accuracy).alias("q")).collect()}
    for i, v in enumerate(numeric):
        v.quartiles = tuple(got[i]) if got.get(i) else (None, None, None)


#: Accuracy of the sketches that give the brackets, and the share of the rows by which a bracket goes beyond a quartile on each side.
_SKETCH_ACCURACY, _MARGIN = 10_000, 0.0004
#: Counted values of all brackets that the driver may pick from; more are picked by running counts in Spark.
_FEW_VALUES = 50_000


def _bracket_quartiles(df: DataFrame, numeric: list[VariableProfile]) -> None:
    """Exact quartiles (A6) without a shuffle of all distinct values.

    Sketches give a bracket of values round every quartile; one scan counts the rows below each bracket and the values inside it,
    and the quartile's neighbours are picked by running counts over these few values.  Counts prove that a bracket holds
    them; one that does not (none is known) gives way to the column's whole range.
    """
    present = [v for v in numeric if v.n_numeric]
    values = df.select(*(finite_double(col(v.name), v.dtype).alias(f"v{v.ordinal}") for v in present))
    shares = [min(1.0, max(0.0, p + d)) for p in QUARTILES for d in (-_MARGIN, _MARGIN)]
    bounds = {}
    for start in range(0, len(present), BATCH):
        chunk = present[start:start + BATCH]
        row = values.agg(*(F.percentile_approx(f"v{v.ordinal}", shares, _SKETCH_ACCURACY) for v in chunk)).first()
        for v, cut in zip(chunk, row):
            for q in range(len(QUARTILES)):
                bounds[v.ordinal, q] = (cut[2 * q], cut[2 * q + 1])
    for _ in range(2):
        bounds = _picked(values, present, bounds) if bounds else {}
    if bounds:
        raise AssertionError(f"no quartile within the whole range of columns {sorted({i for i, _ in bounds})}")


def _picked(values: DataFrame, present: list[VariableProfile], bounds: dict) -> dict:
    """Sets the quartiles whose neighbours lie inside their bounds; the others with the column's whole range."""
    by_ordinal = {v.ordinal: v for v in present}
    keys = sorted(bounds)
    below = {}
    for start in range(0, len(keys), 3 * BATCH):
        chunk = keys[start:start + 3 * BATCH]
        row = values.agg(F.count(F.lit(1)), *(F.count_if(F.col(f"v{i}") < bounds[i, q][0]) for i, q in chunk)).first()
        below.update(zip(chunk, row[1:]))
    cells = [F.when(F.col(f"v{i}").between(*bounds[i, q]), F.struct(F.lit(i).alias("vi"), F.lit(q).alias("q"), F.col(f"v{i}").alias("v"))) for i, q in keys]
    inside = values.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).select("e.*").groupBy("vi", "q", "v").agg(F.count(F.lit(1)).alias("cnt"))
    places = {}
    for i, q in keys:
        at = (by_ordinal[i].n_numeric - 1) * QUARTILES[q]
        low = math.floor(at)
        places[i, q] = (low - below[i, q], min(math.ceil(at), by_ordinal[i].n_numeric - 1) - below[i, q], at - low)
    with Scratch() as tables:
        inside = tables.keep(inside)
        if inside.count() <= _FEW_VALUES:
            got = _neighbours(inside.orderBy("vi", "q", "v").collect(), places)
        else:
            spec = _places(values, [(i, q, low, high) for (i, q), (low, high, _) in places.items()])
            placed = running_before(inside, ["vi", "q"], "v", "cnt", tables=tables).join(F.broadcast(spec), ["vi", "q"])
            end = F.col("before") + F.col("cnt")
            at_low, at_high = ((F.col("before") <= F.col(c)) & (end > F.col(c)) for c in ("low", "high"))
            rows = placed.where(at_low | at_high).groupBy("vi", "q").agg(F.min(F.when(at_low, F.col("v"))).alias("a"), F.max(F.when(at_high, F.col("v"))).alias("b"))
            got = {(r.vi, r.q): (r.a, r.b) for r in rows.collect()}
    missed = {}
    for i, q in keys:
        a, b = got.get((i, q), (None, None))
        v = by_ordinal[i]
        if a is None or b is None:
            missed[i, q] = (float(v.minimum), float(v.maximum))
            continue
        known = list(v.quartiles)
        known[q] = _lerp(a, b, places[i, q][2])
        v.quartiles = tuple(known)
    return missed


def _neighbours(rows: list, places: dict) -> dict:
    """The values at the two places of every quartile, from its bracket's counted values in ascending order."""
    got, before = {}, {}
    for r in rows:
        start = before.get((r.vi, r.q), 0)
        before[r.vi, r.q] = end = start + r.cnt
        a, b = got.get((r.vi, r.q), (None, None))
        low, high, _ = places[r.vi, r.q]
        got[r.vi, r.q] = (r.v if start <= low < end else a, r.v if start <= high < end else b)
    return got


def _places(like: DataFrame, rows: list[tuple]) -> DataFrame:
    """The places of the quartiles: three rows a column."""
    return like.sparkSession.createDataFrame(rows, "vi int, q int, low long, high long")


def profile(df: DataFrame, details: bool = True, exact: bool = True, accuracy: int = 10000) -> Profile:
    """Profile every column of ``df``.

    ``exact=False`` (variable table only, ``details=False``) takes quartiles,
    hence fences and outlier counts, from ``percentile_approx`` sketches: the
    cheap option for very large tables.  The default is exact (pandas rule).
    """
    vars_ = [VariableProfile(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
    rows = _pass1(df, vars_)
    numeric = [v for v in vars_ if v.kind == NUMERIC]
    with Scratch() as tables:
        counts = None
        if details:
            counts = _numeric_pass(df, numeric, tables)
        elif exact:
            _bracket_quartiles(df, numeric)
        elif numeric:
            _approx_quartiles(df, numeric, accuracy)
        parse = parse_counts(df, [v.name for v in vars_ if isinstance(v.dtype, T.StringType)])
        if details:
            tops, distinct, _ = frequency_summary(df, [v.name for v in vars_ if v.kind != NUMERIC], TOP_K)
        for v in vars_:
            if isinstance(v.dtype, T.StringType):
                v.kind = kind_of(v.dtype, parse.get(v.name))
            if details and v.kind != NUMERIC:
                v.top, v.distinct = tops[v.name], distinct[v.name]
        if counts is not None:
            _pass4_from_counts(counts, numeric)
        else:
            _fence_counts(df, numeric)
    return Profile(df.sparkSession, rows, vars_)
