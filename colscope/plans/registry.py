"""Registered queries (Spark) and their SQL oracle twins.

Every query reads whole driver tables (or views Spark derives from them);
doubles are rounded to 4 places on both sides, and every output column has the
same name on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.scalar import CATEGORICAL, NUMERIC, TEMPORAL
from colscope.operators import distributions as dist
from colscope.operators.frequencies import top_k_frame
from colscope.operators.profile import profile
from colscope.operators.semtypes import DATE_FORMATS, SHAPES, TEMPORAL_RATIO, semantic_types
from colscope.plans import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r4(c):
    return F.round(c, 4)


def _round_cols(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[r4(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- SQL helpers

def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_np_quantile(c: str, p: float) -> str:
    """Scalar subquery over ``src``: numpy's linear quantile of column ``c``.

    h = (n-1)p, a/b the values at floor(h)/ceil(h), t = h - floor(h);
    a + t(b-a) below t = 0.5, b - (b-a)(1-t) from 0.5 on (numpy's lerp).
    """
    return f"""(SELECT CASE WHEN max(t) < 0.5 THEN max(a) + max(t) * (max(b) - max(a))
                ELSE max(b) - (max(b) - max(a)) * (1 - max(t)) END
   FROM (SELECT CASE WHEN rn = lo THEN v END AS a, CASE WHEN rn = hi THEN v END AS b, t
         FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn,
                      floor((n - 1) * {p}) AS lo, least(ceil((n - 1) * {p}), n - 1) AS hi,
                      (n - 1) * {p} - floor((n - 1) * {p}) AS t
               FROM (SELECT v, count(*) OVER () AS n
                     FROM (SELECT CAST({q(c)} AS DOUBLE) AS v FROM src WHERE {q(c)} IS NOT NULL)))
         WHERE rn = lo OR rn = hi))"""


def sql_profile_variables(source: str, columns: list[tuple[str, str]]) -> str:
    """columns: (name, kind) in order; kind is the semantic type label."""
    parts = []
    for i, (c, kind) in enumerate(columns):
        if kind == NUMERIC:
            parts.append(f"""SELECT {i} AS ordinal, {lit(c)} AS variable, {lit(kind)} AS variable_type,
  count(t.v) AS valid, count(*) - count(t.v) AS nulls,
  round(max(s.q1), 4) AS q1, round(max(s.q2), 4) AS q2, round(max(s.q3), 4) AS q3,
  CAST(CASE WHEN max(s.q3) - max(s.q1) = 0 OR max(s.q1) IS NULL THEN 0
       ELSE count_if(t.v < s.q1 - 1.5 * (s.q3 - s.q1) OR t.v > s.q3 + 1.5 * (s.q3 - s.q1)) END AS BIGINT) AS outliers
FROM (SELECT CAST({q(c)} AS DOUBLE) AS v FROM src) t,
     (SELECT {sql_np_quantile(c, 0.25)} AS q1, {sql_np_quantile(c, 0.5)} AS q2,
             {sql_np_quantile(c, 0.75)} AS q3) s""")
        else:
            parts.append(f"""SELECT {i} AS ordinal, {lit(c)} AS variable, {lit(kind)} AS variable_type,
  count({q(c)}) AS valid, count(*) - count({q(c)}) AS nulls,
  CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q2, CAST(NULL AS DOUBLE) AS q3,
  CAST(NULL AS BIGINT) AS outliers FROM src""")
    return f"WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts)


def ln_kinds() -> list[tuple[str, str]]:
    return [(c, NUMERIC) for c in tb.LN_NUMERIC] + [
        ("l_returnflag", CATEGORICAL), ("l_linestatus", CATEGORICAL), ("l_shipdate", TEMPORAL)]


# ------------------------------------------------------------- profile

@register("profile_variables", sql_profile_variables(tb.LN_SQL, ln_kinds()))
def q_profile_variables(spark: SparkSession, sf: str) -> DataFrame:
    p = profile(tb.ln(spark, sf), details=False)
    return _round_cols(p.variables_frame(), ["q1", "q2", "q3"])


@register("profile_summary", f"""WITH pv AS ({sql_profile_variables(tb.LN_SQL, ln_kinds())}),
n AS (SELECT count(*) AS r FROM ({tb.LN_SQL}) x)
SELECT max(n.r) AS rows, CAST(count(*) AS INTEGER) AS variables,
  round(CASE WHEN max(n.r) * count(*) = 0 THEN 100.0
        ELSE (max(n.r) * count(*) - sum(pv.nulls)) * 100.0 / (max(n.r) * count(*)) END, 1) AS completeness,
  CAST(sum(pv.nulls) AS BIGINT) AS null_cells, CAST(sum(coalesce(pv.outliers, 0)) AS BIGINT) AS outliers,
  CAST(count_if(pv.variable_type = {lit(NUMERIC)}) AS INTEGER) AS numeric,
  CAST(count_if(pv.variable_type = {lit(CATEGORICAL)}) AS INTEGER) AS categorical,
  CAST(count_if(pv.variable_type = {lit(TEMPORAL)}) AS INTEGER) AS temporal
FROM pv, n""")
def q_profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return profile(tb.ln(spark, sf), details=False).summary_frame()


def sql_numeric_detail(source: str, numeric: list[str], all_columns: list[str]) -> str:
    parts = []
    for c in numeric:
        i = all_columns.index(c)
        v = f"CAST({q(c)} AS DOUBLE)"
        parts.append(f"""SELECT {i} AS ordinal, {lit(c)} AS variable, round(min({v}), 4) AS min, round(max({v}), 4) AS max,
  round(avg({v}), 4) AS mean, round({sql_np_quantile(c, 0.5)}, 4) AS median,
  round(CASE WHEN count({v}) > 1 THEN stddev_samp({v}) WHEN count({v}) = 1 THEN 0 END, 4) AS std FROM src""")
    return f"WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts)


@register("profile_numeric_detail", sql_numeric_detail(tb.LN_SQL, tb.LN_NUMERIC, tb.LN_COLUMNS))
def q_profile_numeric_detail(spark: SparkSession, sf: str) -> DataFrame:
    p = profile(tb.ln(spark, sf), details=False)
    return _round_cols(p.numeric_stats_frame(), ["min", "max", "mean", "median", "std"])


def sql_categorical_detail(source: str, columns: list[tuple[int, str, str]]) -> str:
    parts = []
    for i, c, kind in columns:
        parts.append(f"""SELECT {i} AS ordinal, {lit(c)} AS variable, {lit(kind)} AS variable_type,
  count(DISTINCT {q(c)}) AS distinct_values,
  (SELECT CAST({q(c)} AS VARCHAR) FROM src WHERE {q(c)} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 ASC LIMIT 1) AS mode,
  count(*) - count({q(c)}) AS nulls FROM src""")
    return f"WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts)


def categorical_detail(df: DataFrame) -> DataFrame:
    p = profile(df)
    rows = [
        (v.ordinal, v.name, v.kind, int(v.distinct), v.top[0][0] if v.top else None, int(v.nulls))
        for v in p.variables if v.kind != NUMERIC
    ]
    schema = "ordinal int, variable string, variable_type string, distinct_values long, mode string, nulls long"
    return df.sparkSession.createDataFrame(rows, schema)


@register("profile_categorical_detail", sql_categorical_detail(
    "SELECT * FROM orders", [(2, "o_orderstatus", CATEGORICAL), (4, "o_orderdate", TEMPORAL),
                             (5, "o_orderpriority", CATEGORICAL)]))
def q_profile_categorical_detail(spark: SparkSession, sf: str) -> DataFrame:
    return categorical_detail(tb.load(spark, sf, "orders"))


@register("profile_categorical_detail_docs", sql_categorical_detail(
    tb.DL_SQL, [(1, "text", CATEGORICAL), (2, "lang", CATEGORICAL), (3, "source", CATEGORICAL)]))
def q_profile_categorical_detail_docs(spark: SparkSession, sf: str) -> DataFrame:
    return categorical_detail(tb.dl(spark, sf))


# ------------------------------------------------------- histograms

def sql_histogram(source: str, columns: list[str], right_closed: bool) -> str:
    parts = []
    for c in columns:
        if right_closed:
            params = f"""SELECT least(5, greatest(1, nd)) AS b,
      CASE WHEN mn = mx THEN mn - CASE WHEN mn <> 0 THEN 0.001 * abs(mn) ELSE 0.001 END ELSE mn END AS a0,
      CASE WHEN mn = mx THEN mx + CASE WHEN mx <> 0 THEN 0.001 * abs(mx) ELSE 0.001 END ELSE mx END AS a1,
      CASE WHEN mn = mx THEN 0.0 ELSE (mx - mn) * 0.001 END AS adj FROM s"""
            inside = "t.v > e.lower AND t.v <= e.upper"
        else:
            params = """SELECT least(10, greatest(1, nd)) AS b,
      CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS a0,
      CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS a1, 0.0 AS adj FROM s"""
            inside = "t.v >= e.lower AND (t.v < e.upper OR (e.bin = e.b AND t.v <= e.upper))"
        parts.append(f"""SELECT * FROM (
  WITH t AS (SELECT CAST({q(c)} AS DOUBLE) AS v FROM src WHERE {q(c)} IS NOT NULL),
  s AS (SELECT min(v) AS mn, max(v) AS mx, count(DISTINCT v) AS nd FROM t),
  p AS ({params}),
  g AS (SELECT b, a0, a1, adj, (a1 - a0) / b AS step, unnest(range(1, b + 1)) AS i FROM p),
  e AS (SELECT CAST(i AS INTEGER) AS bin, b,
          CASE WHEN i = 1 THEN a0 - adj ELSE (i - 1) * step + a0 END AS lower,
          CASE WHEN i = b THEN a1 ELSE i * step + a0 END AS upper FROM g)
  SELECT {lit(c)} AS variable, e.bin, round(e.lower, 4) AS lower, round(e.upper, 4) AS upper,
    (SELECT count(*) FROM t WHERE {inside}) AS count FROM e)""")
    return f"WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts)


def _histogram_query(df: DataFrame, columns: list[str], right_closed: bool) -> DataFrame:
    h = dist.histogram_frame(df, columns, right_closed)
    return h.select("variable", "bin", r4(F.col("lower")).alias("lower"), r4(F.col("upper")).alias("upper"), "count")


@register("histogram_right_closed", sql_histogram(tb.LN_SQL, tb.LN_NUMERIC, True))
def q_histogram_right_closed(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram_query(tb.ln(spark, sf), tb.LN_NUMERIC, True)


@register("histogram_left_closed", sql_histogram(tb.LN_SQL, tb.LN_NUMERIC, False))
def q_histogram_left_closed(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram_query(tb.ln(spark, sf), tb.LN_NUMERIC, False)


# ------------------------------------------------------ top-k tables

def sql_top_k(source: str, columns: list[str], k: int, ascending: bool = False) -> str:
    parts = []
    for c in columns:
        order = "cnt ASC, value DESC" if ascending else "cnt DESC, value ASC"
        parts.append(f"""SELECT {lit(c)} AS variable, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position,
  value, cnt AS count, round(cnt * 100.0 / (SELECT count({q(c)}) FROM src), 1) AS percent
FROM (SELECT value, cnt FROM (SELECT CAST({q(c)} AS VARCHAR) AS value, count(*) AS cnt FROM src
      WHERE {q(c)} IS NOT NULL GROUP BY 1) ORDER BY cnt DESC, value ASC LIMIT {k})""")
    return f"WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts)


ORDERS_TOPK = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
DL_TOPK = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@register("top5_counts", sql_top_k("SELECT * FROM orders", ORDERS_TOPK, 5))
def q_top5_counts(spark: SparkSession, sf: str) -> DataFrame:
    return top_k_frame(tb.load(spark, sf, "orders"), ORDERS_TOPK, 5)


@register("top5_percent", sql_top_k(tb.DL_SQL, DL_TOPK, 5))
def q_top5_percent(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of documents with their labels, the whole texts among them."""
    return top_k_frame(tb.dl(spark, sf), DL_TOPK, 5)


@register("top8_counts", sql_top_k("SELECT * FROM orders", ORDERS_TOPK, 8, ascending=True))
def q_top8_counts(spark: SparkSession, sf: str) -> DataFrame:
    return top_k_frame(tb.load(spark, sf, "orders"), ORDERS_TOPK, 8, ascending=True)


# ---------------------------------------------------- types and nulls

def sql_semantic_types(table: str, source: str, columns: list[tuple[str, str]]) -> str:
    """columns: (name, base) with base 'numeric', 'temporal' or 'text'."""
    parts = []
    for i, (c, base) in enumerate(columns):
        if base == "numeric":
            kind = lit(NUMERIC)
        elif base == "temporal":
            kind = lit(TEMPORAL)
        else:
            counts = ", ".join(
                f"count(CASE WHEN regexp_matches({q(c)}, {lit(SHAPES[pat])}) THEN try_strptime({q(c)}, {lit(fmt)}) END)"
                for pat, fmt in DATE_FORMATS)
            kind = (f"(SELECT CASE WHEN count({q(c)}) > 0 AND greatest({counts}) >= {TEMPORAL_RATIO} * count({q(c)}) "
                    f"THEN {lit(TEMPORAL)} ELSE {lit(CATEGORICAL)} END FROM src)")
        parts.append(f"SELECT {lit(table)} AS table_name, {i} AS ordinal, {lit(c)} AS variable, {kind} AS variable_type")
    return f"WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts)


ORDERS_TEXT_BASES = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"),
                     ("o_totalprice", "numeric"), ("o_orderdate", "text"), ("o_orderpriority", "text")]
EVENTS_BASES = [("event_id", "numeric"), ("ts", "temporal"), ("user_id", "numeric"),
                ("event_type", "text"), ("value", "numeric"), ("props", "text")]


def _types_frame(spark, table: str, df: DataFrame) -> DataFrame:
    rows = [(table, i, c, kind) for i, (c, kind) in enumerate(semantic_types(df))]
    return spark.createDataFrame(rows, "table_name string, ordinal int, variable string, variable_type string")


@register("semantic_types",
          sql_semantic_types("orders", tb.ORDERS_TEXT_SQL, ORDERS_TEXT_BASES).replace("WITH src AS", "(WITH src AS", 1)
          + ")\nUNION ALL\n(" + sql_semantic_types("events", "SELECT * FROM events", EVENTS_BASES) + ")")
def q_semantic_types(spark: SparkSession, sf: str) -> DataFrame:
    return _types_frame(spark, "orders", tb.orders_text_dates(spark, sf)).unionByName(
        _types_frame(spark, "events", tb.load(spark, sf, "events")))


def sql_null_counts(table: str, source: str, columns: list[str]) -> str:
    parts = [f"SELECT {lit(table)} AS table_name, {i} AS ordinal, {lit(c)} AS variable, "
             f"count(*) - count({q(c)}) AS nulls, count({q(c)}) AS valid FROM src"
             for i, c in enumerate(columns)]
    return f"(WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts) + ")"


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """A2 for every column in one aggregate, returned long."""
    from colscope.functions.scalar import col, null_or_nan
    fields = df.schema.fields
    agg = df.agg(*[F.count_if(null_or_nan(col(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)],
                 F.count(F.lit(1)).alias("rows"))
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(i).alias("ordinal"), F.lit(f.name).alias("variable"),
                 F.col(f"n{i}").alias("nulls"), (F.col("rows") - F.col(f"n{i}")).alias("valid"))
        for i, f in enumerate(fields)
    ])).alias("e")).select("e.*")


@register("null_counts", sql_null_counts("ln", tb.LN_SQL, tb.LN_COLUMNS) + "\nUNION ALL\n"
          + sql_null_counts("dl", tb.DL_SQL, tb.DL_COLUMNS))
def q_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return null_counts(tb.ln(spark, sf), "ln").unionByName(null_counts(tb.dl(spark, sf), "dl"))


def sql_outliers(table: str, source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT {lit(table)} AS table_name, {lit(c)} AS variable, round(max(s.q1), 4) AS q1, round(max(s.q3), 4) AS q3,
  round(max(s.q1 - 1.5 * (s.q3 - s.q1)), 4) AS lower_fence, round(max(s.q3 + 1.5 * (s.q3 - s.q1)), 4) AS upper_fence,
  CAST(CASE WHEN max(s.q3) - max(s.q1) = 0 OR max(s.q1) IS NULL THEN 0
       ELSE count_if(t.v < s.q1 - 1.5 * (s.q3 - s.q1) OR t.v > s.q3 + 1.5 * (s.q3 - s.q1)) END AS BIGINT) AS outliers
FROM (SELECT CAST({q(c)} AS DOUBLE) AS v FROM src) t,
     (SELECT {sql_np_quantile(c, 0.25)} AS q1, {sql_np_quantile(c, 0.75)} AS q3) s""")
    return f"(WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts) + ")"


OUTLIER_TABLES = [
    ("part", ["p_partkey", "p_size", "p_retailprice"]),
    ("customer", ["c_custkey", "c_nationkey", "c_acctbal"]),
    ("events", ["event_id", "user_id", "value"]),
]


def outliers_frame(df: DataFrame, table: str) -> DataFrame:
    p = profile(df, details=False)
    from colscope.operators.profile import fences
    rows = []
    for v in p.variables:
        if v.kind != NUMERIC:
            continue
        q1, _, q3 = v.quartiles
        f = fences(q1, q3) if q1 is not None else None
        lo, hi = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if q1 is not None else (None, None)
        rows.append((table, v.name, q1, q3, lo, hi, int(v.outliers or 0) if f else 0))
    schema = ("table_name string, variable string, q1 double, q3 double, lower_fence double, "
              "upper_fence double, outliers long")
    out = df.sparkSession.createDataFrame(rows, schema)
    return _round_cols(out, ["q1", "q3", "lower_fence", "upper_fence"])


@register("iqr_outliers_by_column", "\nUNION ALL\n".join(
    sql_outliers(t, f"SELECT * FROM {t}", cols) for t, cols in OUTLIER_TABLES))
def q_iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    frames = [outliers_frame(tb.load(spark, sf, t).select(*cols), t) for t, cols in OUTLIER_TABLES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ------------------------------------------------------------ pivot

from colscope.operators.pivot import pivot_long, pivot_report  # noqa: E402

SQL_AGG = {
    "sum": "coalesce(sum({v}), 0)",
    "mean": "avg({v})",
    "median": "median(CAST({v} AS DOUBLE))",
    "min": "min({v})",
    "max": "max({v})",
    "count": "count(DISTINCT {v})",
}


def sql_pivot(source: str, rows: list[str], columns: list[str], value: str, function: str,
              text_value: bool = False, typed_keys: tuple = (), headers: tuple = ()) -> str:
    """Oracle pivot: group on blank-filled keys, drop null aggregates, spread by conditional aggregation.

    ``headers``: the expected header texts, written out.
    ``typed_keys``: non-text keys without nulls, which keep their type.
    """
    def key(c):
        if c in typed_keys:
            return q(c)
        return f"coalesce(CAST({q(c)} AS VARCHAR), {lit('(En blanco)')})"
    agg = SQL_AGG[function].format(v=q(value))
    row_keys = ", ".join(f"{key(c)} AS {q(c)}" for c in rows)
    row_names = ", ".join(q(c) for c in rows)
    cell = "''" if text_value else "0"
    wrap = (lambda e: e) if text_value else (lambda e: f"round({e}, 4)")
    if not columns:
        return f"""WITH src AS ({source}),
g AS (SELECT {row_keys}, {agg} AS agg FROM src GROUP BY ALL)
SELECT {row_names}, {wrap('agg')} AS {q(value)} FROM g WHERE agg IS NOT NULL"""
    hdr = "concat_ws(' - ', " + ", ".join(key(c) for c in columns) + ")"
    cells = ", ".join(f"{wrap(f'coalesce(first(agg) FILTER (WHERE hdr = {lit(h)}), {cell})')} AS {q(h)}" for h in headers)
    return f"""WITH src AS ({source}),
g AS (SELECT {row_keys}, {hdr} AS hdr, {agg} AS agg FROM src GROUP BY ALL)
SELECT {row_names}, {cells} FROM g WHERE agg IS NOT NULL GROUP BY {row_names}"""


def _pivot_query(df: DataFrame, rows, columns, value, function, text_value=False) -> DataFrame:
    out = pivot_report(df, rows, columns, value, function)
    if text_value:
        return out
    return out.select(*[F.col(f"`{c}`") if c in rows else r4(F.col(f"`{c}`")).alias(c) for c in out.columns])


PIVOT_LN = (["l_returnflag"], ["l_linestatus"], "l_quantity")
for _fn in ["sum", "mean", "median", "min", "max"]:
    def _make(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return _pivot_query(tb.ln(spark, sf), *PIVOT_LN, fn)
        run.__name__ = f"q_pivot_{fn}"
        return run
    register(f"pivot_{_fn}", sql_pivot(tb.LN_SQL, *PIVOT_LN, _fn, headers=("F", "O")))(_make(_fn))


@register("pivot_count_distinct", sql_pivot(tb.LN_SQL, ["l_returnflag"], ["l_linestatus"], "l_discount", "count", headers=("F", "O")))
def q_pivot_count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return _pivot_query(tb.ln(spark, sf), ["l_returnflag"], ["l_linestatus"], "l_discount", "count")


@register("pivot_rows_only", sql_pivot(tb.LN_SQL, ["l_returnflag", "l_linestatus"], [], "l_extendedprice", "sum"))
def q_pivot_rows_only(spark: SparkSession, sf: str) -> DataFrame:
    return _pivot_query(tb.ln(spark, sf), ["l_returnflag", "l_linestatus"], [], "l_extendedprice", "sum")


@register("pivot_two_column_keys", sql_pivot(tb.LN_SQL, ["l_linestatus"], ["l_returnflag", "l_linenumber"],
                                             "l_discount", "mean", headers=tuple(
                                                 f"{flag} - {line}" for flag in ("(En blanco)", "A", "N", "R") for line in range(1, 8)
                                                 if line != 6 and (flag, line) != ("N", 5) and (flag != "(En blanco)" or line == 5))))
def q_pivot_two_column_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _pivot_query(tb.ln(spark, sf), ["l_linestatus"], ["l_returnflag", "l_linenumber"], "l_discount", "mean")


@register("pivot_text_max", sql_pivot("SELECT * FROM customer", ["c_nationkey"], ["c_mktsegment"], "c_name", "max",
                                      text_value=True, typed_keys=("c_nationkey",),
                                      headers=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
def q_pivot_text_max(spark: SparkSession, sf: str) -> DataFrame:
    return _pivot_query(tb.load(spark, sf, "customer"), ["c_nationkey"], ["c_mktsegment"], "c_name", "max",
                        text_value=True)


LN_ODD_KEYS_SQL = f"""SELECT CASE WHEN l_linenumber = 1 THEN '(En blanco)' WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS flag,
  CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE WHEN l_linenumber = 4 THEN NULL ELSE l_tax END AS tax, l_linestatus,
  CASE WHEN l_linenumber = 5 THEN 'NaN'::DOUBLE ELSE l_quantity END AS quantity FROM lineitem"""


def _ln_odd_keys(spark: SparkSession, sf: str) -> DataFrame:
    line, nan = F.col("l_linenumber"), F.lit(float("nan"))
    return tb.load(spark, sf, "lineitem").select(
        F.when(line == 1, "(En blanco)").when(line == 2, None).otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(line == 3, nan).when(line == 4, None).otherwise(F.col("l_tax")).alias("tax"), "l_linestatus",
        F.when(line == 5, nan).otherwise(F.col("l_quantity")).alias("quantity"))


def _register_odd_pivots() -> None:
    for fn in ("sum", "median", "max", "count"):
        value = "CASE WHEN isnan(quantity) THEN NULL ELSE quantity END"
        agg = SQL_AGG[fn].format(v=f"({value})")
        cells = ", ".join(f"round(coalesce(first(agg) FILTER (WHERE hdr = '{h}'), 0), 4) AS \"{h}\"" for h in ("F", "O"))
        sql = f"""WITH src AS ({LN_ODD_KEYS_SQL}),
g AS (SELECT coalesce(flag, '(En blanco)') AS flag, CASE WHEN tax IS NULL OR isnan(tax) THEN '(En blanco)' ELSE tax::VARCHAR END AS tax,
  l_linestatus AS hdr, {agg} AS agg FROM src GROUP BY ALL)
SELECT flag, tax, {cells} FROM g WHERE agg IS NOT NULL GROUP BY flag, tax"""

        def run(spark: SparkSession, sf: str, fn=fn) -> DataFrame:
            return _pivot_query(_ln_odd_keys(spark, sf), ["flag", "tax"], ["l_linestatus"], "quantity", fn)
        run.__name__ = f"q_pivot_odd_keys_{fn}"
        run.__doc__ = "Pivot with NULL and literal blank keys, and NaN among keys and values."
        register(f"pivot_odd_keys_{fn}", sql)(run)


_register_odd_pivots()


@register("pivot_long_cells", """SELECT l_returnflag, concat_ws(' - ', l_orderkey::VARCHAR, l_linenumber::VARCHAR) AS header, round(sum(l_quantity), 4) AS value
FROM lineitem GROUP BY ALL""")
def q_pivot_long(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a pivot whose column keys are far more than any wide table holds."""
    out = pivot_long(tb.load(spark, sf, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], "l_quantity", "sum")
    return out.withColumn("value", r4(F.col("value")))


# ------------------------------------------------------- correlation

from colscope.operators import correlation as corr  # noqa: E402


def sql_pearson_cell(x: str, y: str, src: str = "src") -> str:
    return (f"SELECT {lit(x)} AS id_x, {lit(y)} AS id_y, round(CASE WHEN var_pop({q(x)}) FILTER (WHERE {q(y)} IS NOT NULL) > 0 "
            f"AND var_pop({q(y)}) FILTER (WHERE {q(x)} IS NOT NULL) > 0 THEN corr({q(y)}, {q(x)}) END, 4) AS valor FROM {src}")


def sql_spearman_cell(x: str, y: str) -> str:
    return f"""SELECT {lit(x)} AS id_x, {lit(y)} AS id_y,
  round(CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END, 4) AS valor
FROM (SELECT rank() OVER (ORDER BY {q(x)}) + (count(*) OVER (PARTITION BY {q(x)}) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY {q(y)}) + (count(*) OVER (PARTITION BY {q(y)}) - 1) / 2.0 AS ry
      FROM src WHERE {q(x)} IS NOT NULL AND {q(y)} IS NOT NULL)"""


def sql_kendall_cell(x: str, y: str) -> str:
    if x == y:
        return (f"SELECT {lit(x)} AS id_x, {lit(y)} AS id_y, CASE WHEN count({q(x)}) > 0 THEN 1.0 END AS valor FROM src")
    return f"""SELECT {lit(x)} AS id_x, {lit(y)} AS id_y,
  round(CASE WHEN (n0 - n1) * (n0 - n2) > 0 THEN s / sqrt((n0 - n1) * (n0 - n2)) END, 4) AS valor
FROM (SELECT CAST(count(*) AS DOUBLE) AS n0, CAST(count_if(a.x = b.x) AS DOUBLE) AS n1,
             CAST(count_if(a.y = b.y) AS DOUBLE) AS n2, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s
      FROM (SELECT row_number() OVER () AS rid, {q(x)} AS x, {q(y)} AS y FROM src
            WHERE {q(x)} IS NOT NULL AND {q(y)} IS NOT NULL) a
      JOIN (SELECT row_number() OVER () AS rid, {q(x)} AS x, {q(y)} AS y FROM src
            WHERE {q(x)} IS NOT NULL AND {q(y)} IS NOT NULL) b ON a.rid < b.rid)"""


def sql_matrix(source: str, cols: list[str], cell) -> str:
    parts = [cell(x, y) for y in cols for x in cols]
    return f"WITH src AS ({source})\n" + "\nUNION ALL\n".join(parts)


def _double_cols(source: str, cols: list[str]) -> str:
    return "SELECT " + ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in cols) + f" FROM ({source}) b"


LNC_D = _double_cols(tb.LNC_SQL, tb.LNC_NUMERIC)
DROP_SQL = f"SELECT * FROM ({LNC_D}) d WHERE " + " AND ".join(f"{q(c)} IS NOT NULL" for c in tb.LNC_NUMERIC)
IMPUTE_SQL = ("SELECT " + ", ".join(f"coalesce({q(c)}, (SELECT avg({q(c)}) FROM ({LNC_D}) m)) AS {q(c)}"
                                    for c in tb.LNC_NUMERIC) + f" FROM ({LNC_D}) d")


def _matrix(df: DataFrame, strategy: str, method: str) -> DataFrame:
    cols = corr.select_numeric(df)
    ready = corr.apply_null_strategy(df, cols, strategy)
    return corr.heatmap_cells(corr.matrix_pairs(ready, cols, method), cols)


@register("corr_pairwise_pearson", sql_matrix(LNC_D, tb.LNC_NUMERIC, sql_pearson_cell))
def q_corr_pairwise_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(tb.lnc(spark, sf), "ignorar", "pearson")


@register("corr_drop_rows", sql_matrix(DROP_SQL, tb.LNC_NUMERIC, sql_pearson_cell))
def q_corr_drop_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(tb.lnc(spark, sf), "eliminar_filas", "pearson")


@register("corr_impute_mean", sql_matrix(IMPUTE_SQL, tb.LNC_NUMERIC, sql_pearson_cell))
def q_corr_impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(tb.lnc(spark, sf), "imputar_promedio", "pearson")


SPEARMAN_COLS = tb.LNC_NUMERIC


@register("corr_spearman", sql_matrix(_double_cols(tb.LNC_SQL, SPEARMAN_COLS), SPEARMAN_COLS, sql_spearman_cell))
def q_corr_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(tb.lnc(spark, sf).select(*SPEARMAN_COLS), "ignorar", "spearman")


LINEITEM_RANK_COLS = tb.LN_NUMERIC


@register("corr_spearman_lineitem", sql_matrix(_double_cols("SELECT * FROM lineitem", LINEITEM_RANK_COLS),
                                               LINEITEM_RANK_COLS, sql_spearman_cell))
def q_corr_spearman_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """All eight numeric columns, none with nulls: the per-column rank plan."""
    return _matrix(tb.load(spark, sf, "lineitem").select(*LINEITEM_RANK_COLS), "ignorar", "spearman")


EDGE_SQL = """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS v FROM lineitem),
names(n) AS (VALUES ('l_quantity'), ('l_extendedprice'), ('constant'), ('infinite'))
SELECT a.n AS id_x, b.n AS id_y,
  CASE WHEN a.n IN ('constant', 'infinite') OR b.n IN ('constant', 'infinite') THEN NULL
       WHEN a.n = b.n THEN 1.0 ELSE round(r.v, 4) END AS valor
FROM names a, names b, r"""


@register("corr_edge_columns", EDGE_SQL)
def q_corr_edge_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A constant column and one infinite value: no coefficient, however the rows fall into batches."""
    df = tb.load(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", F.lit(7.0).alias("constant"),
        F.when(F.col("l_orderkey") < 10, float("inf")).otherwise(F.col("l_tax")).alias("infinite"))
    return _matrix(df, "ignorar", "pearson")


PART_CORR = ["p_partkey", "p_size", "p_retailprice"]
CUSTOMER_CORR = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("corr_spearman_part", sql_matrix(_double_cols("SELECT * FROM part", PART_CORR), PART_CORR, sql_spearman_cell))
def q_corr_spearman_part(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(tb.load(spark, sf, "part").select(*PART_CORR), "ignorar", "spearman")


@register("corr_kendall", sql_matrix(_double_cols("SELECT * FROM part", PART_CORR), PART_CORR, sql_kendall_cell))
def q_corr_kendall(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(tb.load(spark, sf, "part").select(*PART_CORR), "ignorar", "kendall")


@register("corr_kendall_customer",
          sql_matrix(_double_cols("SELECT * FROM customer", CUSTOMER_CORR), CUSTOMER_CORR, sql_kendall_cell))
def q_corr_kendall_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(tb.load(spark, sf, "customer").select(*CUSTOMER_CORR), "ignorar", "kendall")


def sql_kendall_sorted(source: str, cols: list[str]) -> str:
    """Tau-b of every pair for large tables: discordant pairs by the bits of the dense rank of y, each "0" row counting the
    "1" rows of its prefix with a smaller x; ties from group counts."""
    pairs = "\nUNION ALL\n".join(
        f"SELECT {i} AS i, {j} AS j, {q(x)}::DOUBLE AS x, {q(cols[j])}::DOUBLE AS y FROM src WHERE {q(x)} IS NOT NULL AND {q(cols[j])} IS NOT NULL"
        for i, x in enumerate(cols) for j in range(i + 1, len(cols)))
    names = ", ".join(f"({i}, {lit(c)})" for i, c in enumerate(cols))
    return f"""WITH src AS ({source}), p AS MATERIALIZED ({pairs}),
c AS MATERIALIZED (SELECT i, j, x, dense_rank() OVER (PARTITION BY i, j ORDER BY y) - 1 AS yr, y, c FROM (SELECT i, j, x, y, count(*) AS c FROM p GROUP BY ALL)),
lev AS (SELECT i, j, l, yr >> (l + 1) AS prefix, x, sum(CASE WHEN (yr >> l) & 1 = 1 THEN c ELSE 0 END) AS ones, sum(CASE WHEN (yr >> l) & 1 = 0 THEN c ELSE 0 END) AS zeros
  FROM c, range(0, 24) r(l) WHERE l <= (SELECT floor(log2(greatest(max(yr), 1))) FROM c) GROUP BY ALL),
run AS (SELECT i, j, zeros, sum(ones) OVER (PARTITION BY i, j, l, prefix ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lev),
d AS (SELECT i, j, sum(zeros::DOUBLE * coalesce(before, 0)) AS d FROM run GROUP BY i, j),
n3 AS (SELECT i, j, sum(c) AS n, sum(c::DOUBLE * (c - 1) / 2) AS n3 FROM c GROUP BY i, j),
n1 AS (SELECT i, j, sum(t::DOUBLE * (t - 1) / 2) AS n1 FROM (SELECT i, j, x, sum(c) AS t FROM c GROUP BY i, j, x) GROUP BY i, j),
n2 AS (SELECT i, j, sum(t::DOUBLE * (t - 1) / 2) AS n2 FROM (SELECT i, j, y, sum(c) AS t FROM c GROUP BY i, j, y) GROUP BY i, j),
tau AS (SELECT i, j, CASE WHEN (n0 - n1) * (n0 - n2) > 0 THEN round((n0 - n1 - n2 + n3 - 2 * d) / (sqrt(n0 - n1) * sqrt(n0 - n2)), 4) END AS r
  FROM (SELECT *, n::DOUBLE * (n - 1) / 2 AS n0 FROM d JOIN n1 USING (i, j) JOIN n2 USING (i, j) JOIN n3 USING (i, j))),
names(k, name) AS (VALUES {names}),
cells AS (SELECT i, j, r FROM tau UNION ALL SELECT j, i, r FROM tau UNION ALL SELECT k, k, 1.0 FROM names)
SELECT a.name AS id_x, b.name AS id_y, c.r AS valor FROM cells c JOIN names a ON a.k = c.j JOIN names b ON b.k = c.i"""


@register("corr_kendall_lineitem", sql_kendall_sorted(tb.LN_SQL, tb.LN_NUMERIC))
def q_corr_kendall_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """All numeric columns of lineitem, two of them with nulls."""
    return _matrix(tb.ln(spark, sf).select(*tb.LN_NUMERIC), "ignorar", "kendall")


RANK_EDGE_COLS = ["l_quantity", "l_extendedprice", "constant", "infinite", "l_discount"]


@register("corr_spearman_edge", sql_matrix("""SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, 7.0::DOUBLE AS constant,
  CASE WHEN l_orderkey < 10 THEN 'Infinity'::DOUBLE WHEN l_orderkey % 5 > 0 THEN l_tax::DOUBLE END AS infinite, l_discount::DOUBLE AS l_discount FROM lineitem""",
                                           RANK_EDGE_COLS, sql_spearman_cell))
def q_corr_spearman_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks beside a constant column and one with infinite and missing values."""
    infinite = F.when(F.col("l_orderkey") < 10, float("inf")).when(F.col("l_orderkey") % 5 > 0, F.col("l_tax"))
    df = tb.load(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", F.lit(7.0).alias("constant"), infinite.alias("infinite"), "l_discount")
    return _matrix(df, "ignorar", "spearman")


def sql_pair_table(source: str, cols: list[str]) -> str:
    parts = []
    for i, x in enumerate(cols):
        for j in range(i + 1, len(cols)):
            y = cols[j]
            parts.append(f"SELECT {i} AS i, {j} AS j, {lit(x)} AS v1, {lit(y)} AS v2, "
                         f"round(CASE WHEN var_pop({q(x)}) FILTER (WHERE {q(y)} IS NOT NULL) > 0 AND "
                         f"var_pop({q(y)}) FILTER (WHERE {q(x)} IS NOT NULL) > 0 THEN corr({q(x)}, {q(y)}) END, 4) AS r FROM src")
    return f"WITH src AS ({source}), pairs AS (" + "\nUNION ALL\n".join(parts) + ")"


STRONG_SQL = sql_pair_table(LNC_D, tb.LNC_NUMERIC) + """,
strong AS (SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC, i, j) AS INTEGER) AS position,
                  v1 AS variable_1, v2 AS variable_2, r AS coefficient,
                  CASE WHEN r > 0 THEN 'Directa' ELSE 'Inversa' END AS kind
           FROM pairs WHERE abs(r) >= 0.7)"""


@register("corr_strong_pairs", STRONG_SQL + "\nSELECT * FROM strong")
def q_corr_strong_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rep = corr.correlation_report(tb.lnc(spark, sf))
    return rep["strong_pairs"]


@register("corr_key_variables", STRONG_SQL + """,
seen AS (SELECT variable_1 AS variable, position * 2 AS seen_at FROM strong
         UNION ALL SELECT variable_2, position * 2 + 1 FROM strong)
SELECT variable, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, min(seen_at)) AS INTEGER) AS position
FROM seen GROUP BY variable""")
def q_corr_key_variables(spark: SparkSession, sf: str) -> DataFrame:
    rep = corr.correlation_report(tb.lnc(spark, sf))
    return rep["key_variables"]


def sql_significance(source: str, cols: list[str]) -> str:
    """Two-sided p-values: Student's density, by lgamma, integrated by Simpson's rule from |t| to |t| + 20."""
    pairs = "\nUNION ALL\n".join(f"SELECT {lit(x)} AS a, {lit(y)} AS b, corr({q(y)}, {q(x)}) AS r, count(*) - 2.0 AS nu FROM src"
                                 for i, x in enumerate(cols) for y in cols[i + 1:])
    names = ", ".join(f"({lit(c)})" for c in cols)
    return f"""WITH src AS ({source}), pairs AS ({pairs}),
t AS (SELECT a, b, nu, abs(r) / sqrt(greatest(1 - r * r, 1e-300)) * sqrt(nu) AS t FROM pairs WHERE NOT isnan(r)),
p AS (SELECT a, b, round(2 * 0.005 / 3 * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
    * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2) - ln(nu * pi()) / 2 - (nu + 1) / 2 * ln(1 + pow(t + 0.005 * k, 2) / nu))), 4) AS p
  FROM t, range(4001) g(k) GROUP BY a, b)
SELECT a AS id_y, b AS id_x, p AS p_value FROM p
UNION ALL SELECT b, a, p FROM p
UNION ALL SELECT n, n, 0.0 FROM (VALUES {names}) v(n)"""


@register("corr_significance", sql_significance(DROP_SQL, tb.LNC_NUMERIC))
def q_corr_significance(spark: SparkSession, sf: str) -> DataFrame:
    rep = corr.correlation_report(tb.lnc(spark, sf))
    return rep["significance"]


# ------------------------------------------ balance, selection, charts

from colscope.operators import balance as bal  # noqa: E402


#: Words of an outcome, as the rule states them; written out, not taken from the operator.
OUTCOME_WORDS = """target objetivo clase class label resultado status estado churn abandono fraude fraud default incumplimiento
  aprobado cancel salida exited response respuesta diagnostico diagnóstico perdida pérdida loss attrition retencion retención retained"""


def sql_class_balance(source: str, columns: list[str]) -> str:
    words = " + ".join(f"CASE WHEN contains(lower(name), {lit(w)}) THEN 1 ELSE 0 END" for w in OUTCOME_WORDS.split())
    nd = "\nUNION ALL\n".join(
        f"SELECT {lit(c)} AS name, count(DISTINCT CAST({q(c)} AS VARCHAR)) AS nd FROM src" for c in columns)
    counts = "\nUNION ALL\n".join(
        f"SELECT {lit(c)} AS name, CAST({q(c)} AS VARCHAR) AS class, count(*) AS count FROM src "
        f"WHERE {q(c)} IS NOT NULL GROUP BY 2" for c in columns)
    return f"""WITH src AS ({source}),
nd AS ({nd}),
cand AS (SELECT name, nd, {words} AS hits FROM nd
         WHERE nd BETWEEN 2 AND 10
           AND NOT (lower(name) IN ('id', 'index', 'indice', 'índice') OR suffix(lower(name), '_id'))),
pick AS (SELECT name FROM cand ORDER BY hits DESC, nd ASC, name DESC LIMIT 1),
counts AS ({counts}),
chosen AS (SELECT c.* FROM counts c JOIN pick p ON c.name = p.name),
tot AS (SELECT sum(count) AS total, count(*) AS classes FROM chosen),
dist AS (SELECT name, class, count, round(count * 100.0 / total, 2) AS percent, classes,
                row_number() OVER (ORDER BY count DESC, class ASC) AS position FROM chosen, tot),
ext AS (SELECT max(percent) FILTER (WHERE position = 1) AS major,
               max(percent) FILTER (WHERE position = classes) AS minor FROM dist),
rat AS (SELECT major, minor, CASE WHEN minor <> 0 THEN round(major / minor, 2) END AS ratio FROM ext)
SELECT name AS variable, CAST(position AS INTEGER) AS position, class, count, percent,
  CAST(classes AS INTEGER) AS classes, major AS majority_pct, minor AS minority_pct, ratio,
  CASE WHEN major >= 80 OR coalesce(ratio, 0) >= 4 THEN 'desbalance marcado'
       WHEN major >= 65 OR coalesce(ratio, 0) >= 2 THEN 'desbalance moderado'
       ELSE 'balance relativo' END AS level
FROM dist, rat"""


def sql_balance_statement(source: str, columns: list[str]) -> str:
    """One row: the balance of the assumed target, or the diagnosis that there is none."""
    return f"""WITH b AS ({sql_class_balance(source, columns)}),
s AS (SELECT any_value(variable) AS variable, any_value(classes) AS classes, any_value(majority_pct) AS majority_pct, any_value(minority_pct) AS minority_pct,
  any_value(ratio) AS ratio, any_value(level) AS level, count(*) AS n FROM b)
SELECT variable, classes, majority_pct, minority_pct, ratio, level,
  CASE WHEN n = 0 THEN 'No se identificó una variable objetivo plausible con entre 2 y 10 clases.' END AS diagnosis,
  CASE WHEN n > 0 THEN 'Marcado si la clase mayoritaria alcanza 80% o la razón mayoritaria/minoritaria es al menos 4; moderado desde 65% o razón 2.' END AS criterion,
  CASE WHEN n = 0 THEN 'No es posible concluir si el dataset está balanceado sin definir el objetivo del estudio.'
    ELSE 'El dataset no declara una variable objetivo. Esta variable se usa únicamente para ilustrar cómo sería el balance si se quisiera clasificar los registros con base en ella.'
    END AS warning FROM s"""


ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("class_balance", sql_class_balance("SELECT * FROM orders", ORDERS_COLS))
def q_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return bal.class_balance_frame(tb.load(spark, sf, "orders"))


@register("class_balance_labels", sql_class_balance("SELECT * FROM labels", ["doc_id", "quality", "toxic"]))
def q_class_balance_labels(spark: SparkSession, sf: str) -> DataFrame:
    return bal.class_balance_frame(tb.load(spark, sf, "labels"))


@register("balance_statement", sql_balance_statement("SELECT * FROM orders", ORDERS_COLS))
def q_balance_statement(spark: SparkSession, sf: str) -> DataFrame:
    return bal.balance_statement_frame(tb.load(spark, sf, "orders"))


@register("balance_no_candidate", sql_balance_statement("SELECT o_orderkey, o_custkey, o_totalprice FROM orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def q_balance_no_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """A table without a column of 2 to 10 classes: one row with the diagnosis."""
    return bal.balance_statement_frame(tb.load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


# ------------------------------------------------------- paging, catalog (L1, X11)

from colscope.operators.catalog import list_all_datasets, list_datasets  # noqa: E402
from colscope.operators.paging import page_rows  # noqa: E402

PAGE_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 25
OFFSET (SELECT (least({page}, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT))) - 1) * 25 FROM orders)"""


@register("page_rows", PAGE_SQL.format(page=3))
def q_page_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = page_rows(tb.load(spark, sf, "orders"), ["o_orderkey"], page=3, size=25)
    return rows


@register("page_rows_deep", PAGE_SQL.format(page=400))
def q_page_rows_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Page 400 through the distributed row positions (no shallow shortcut)."""
    rows, _ = page_rows(tb.load(spark, sf, "orders"), ["o_orderkey"], page=400, size=25)
    return rows


@register("page_rows_events", r"""SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '') AS ts,
  user_id, event_type, value, props FROM events ORDER BY events.ts, event_id LIMIT 200 OFFSET 400""")
def q_page_rows_events(spark: SparkSession, sf: str) -> DataFrame:
    """Page 3 by a time stamp with fractions of seconds."""
    rows, _ = page_rows(tb.load(spark, sf, "events"), ["ts", "event_id"], page=3, size=200)
    return rows


def orders_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset registry derived from orders: one dataset per order, owned by its customer."""
    o = tb.load(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("pedido_"), k).alias("name"),
        F.col("o_orderpriority").alias("description"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("ventas "), k, F.lit(".csv"))).alias("file_name"),
        F.concat(F.lit("/datos/u"), F.col("o_custkey").cast("string"), F.lit("/d"), k, F.lit("/archivo_"), k,
                 F.lit(".xlsx")).alias("path"),
        F.round("o_totalprice").cast("long").alias("size_bytes"),
        F.col("o_orderdate").alias("uploaded_at"), F.col("o_custkey").alias("owner_id"),
        F.col("o_orderstatus").alias("_status"),
    )


LISTING_OWNER = 605


@register("owner_listing", f"""WITH cat AS (
  SELECT o_orderkey AS id, 'pedido_' || CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS description,
         CASE WHEN o_orderstatus = 'F' THEN 'ventas ' || CAST(o_orderkey AS VARCHAR) || '.csv' END AS file_name,
         '/datos/u' || CAST(o_custkey AS VARCHAR) || '/d' || CAST(o_orderkey AS VARCHAR) || '/archivo_'
           || CAST(o_orderkey AS VARCHAR) || '.xlsx' AS path,
         CAST(round(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS uploaded_at, o_custkey AS owner_id,
         o_orderstatus AS status FROM orders),
mine AS (SELECT *, coalesce(nullif(file_name, ''), string_split(path, '/')[-1]) AS shown FROM cat
         WHERE owner_id = {LISTING_OWNER})
SELECT id, name, description, shown AS file_name, size_bytes,
       strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') AS uploaded_at,
       upper(regexp_extract(shown, '\\.([^./]+)$', 1)) AS format, 'Disponible' AS state,
       id IN (SELECT id FROM cat WHERE status = 'P') AS report_available,
       CASE WHEN id IN (SELECT id FROM cat WHERE status = 'P') THEN '/resumen/datasets/' || id::VARCHAR || '/pdf' END AS report_url
FROM mine""")
def q_owner_listing(spark: SparkSession, sf: str) -> DataFrame:
    cat = orders_catalog(spark, sf)
    reports = cat.where(F.col("_status") == "P").select("id")
    out = list_datasets(cat.drop("_status"), LISTING_OWNER, reports)
    return out.withColumn("uploaded_at", F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss"))


# ------------------------------------------------------------ report tables

from colscope.operators import report as rep  # noqa: E402


@register("report_indicators", "WITH s AS (" + ORACLE["profile_summary"] + ")\n" + "\nUNION ALL\n".join(
    f"SELECT {pos} AS position, {lit(label)} AS label, CAST({field} AS VARCHAR)"
    + (" || '%'" if field == "completeness" else "") + " AS value FROM s"
    for pos, (field, label) in enumerate(rep.INDICATORS, start=1)))
def q_report_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return rep.indicators(profile(tb.ln(spark, sf), details=False).summary_frame())


@register("report_appendix", "WITH pv AS (" + ORACLE["profile_variables"] + """)
SELECT ordinal, variable, variable_type, valid, nulls, coalesce(CAST(outliers AS VARCHAR), 'N/A') AS outliers FROM pv""")
def q_report_appendix(spark: SparkSession, sf: str) -> DataFrame:
    return rep.appendix(profile(tb.ln(spark, sf), details=False).variables_frame())


@register("report_file_names", r"""SELECT o_orderkey AS id,
  'resumen_ejecutivo_' || coalesce(nullif(trim(regexp_replace(regexp_replace(o_orderpriority, '^\s+|\s+$', '', 'g'),
      '[^a-zA-Z0-9_-]+', '_', 'g'), '_'), ''), 'dataset') || '.pdf' AS report_file
FROM orders""")
def q_report_file_names(spark: SparkSession, sf: str) -> DataFrame:
    o = tb.load(spark, sf, "orders")
    return rep.download_names(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")))


@register("safe_names", r"""WITH raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '  Año 2024/ventas.csv ' WHEN 1 THEN '..' WHEN 2 THEN o_orderpriority
    WHEN 3 THEN 'Ana.Ruiz+' || o_custkey::VARCHAR || '@correo.es' ELSE '_' || o_orderstatus || '-.' END AS raw FROM orders),
t AS (SELECT id, raw, lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS low FROM raw)
SELECT id, coalesce(nullif(regexp_replace(low, '[^a-zA-Z0-9._-]+', '_', 'g'), ''), 'usuario_sin_identificador') AS owner_folder,
  coalesce(nullif(regexp_replace(regexp_replace(low, '[^a-zA-Z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'dataset') AS dataset_folder,
  coalesce(nullif(regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'dataset') AS dataset_file FROM t""")
def q_safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """Folder and file names made safe, from names derived from all orders."""
    from colscope.functions.scalar import file_name, folder_name
    key = F.col("o_orderkey")
    raw = (F.when(key % 5 == 0, "  Año 2024/ventas.csv ").when(key % 5 == 1, "..").when(key % 5 == 2, F.col("o_orderpriority"))
           .when(key % 5 == 3, F.concat(F.lit("Ana.Ruiz+"), F.col("o_custkey").cast("string"), F.lit("@correo.es")))
           .otherwise(F.concat(F.lit("_"), F.col("o_orderstatus"), F.lit("-."))))
    return tb.load(spark, sf, "orders").select(key.alias("id"), folder_name(raw).alias("owner_folder"), file_name(raw, lower=True).alias("dataset_folder"),
                                               file_name(raw).alias("dataset_file"))


@register("owner_listing_all", """WITH cat AS (
  SELECT o_orderkey AS id, o_custkey AS owner_id,
         CASE WHEN o_orderstatus = 'F' THEN 'ventas ' || CAST(o_orderkey AS VARCHAR) || '.csv' END AS file_name,
         '/datos/u' || CAST(o_custkey AS VARCHAR) || '/d' || CAST(o_orderkey AS VARCHAR) || '/archivo_'
           || CAST(o_orderkey AS VARCHAR) || '.xlsx' AS path,
         o_orderdate AS uploaded_at, o_orderstatus AS status FROM orders),
shown AS (SELECT *, coalesce(nullif(file_name, ''), string_split(path, '/')[-1]) AS shown_name FROM cat)
SELECT owner_id, id, shown_name AS file_name, upper(regexp_extract(shown_name, '\\.([^./]+)$', 1)) AS format,
       strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') AS uploaded_at, status = 'P' AS report_available,
       CAST(row_number() OVER (PARTITION BY owner_id ORDER BY uploaded_at DESC, id DESC) AS INTEGER) AS position
FROM shown""")
def q_owner_listing_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every owner's datasets, newest first, with the position within the owner's list."""
    cat = orders_catalog(spark, sf)
    reports = cat.where(F.col("_status") == "P").select("id")
    out = list_all_datasets(cat.drop("_status"), reports)
    return out.select("owner_id", "id", "file_name", "format",
                      F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("uploaded_at"),
                      "report_available", "position")


# ------------------------------------------------------ queries kept in modules of their own

from colscope.plans import detail_queries, source_queries  # noqa: E402, F401
