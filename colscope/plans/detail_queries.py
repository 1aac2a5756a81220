"""Queries of the whole profile, its JSON context, the selection and the chart data, as rows, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.scalar import NUMERIC
from colscope.operators import selection as sel
from colscope.operators.profile import profile
from colscope.plans import tables as tb
from colscope.plans.registry import ORACLE, lit, ln_kinds, q, register, sql_np_quantile, sql_profile_variables
from colscope.sources.store import profile_context, profile_tables

LN_TYPES = {"l_orderkey": "long", "l_partkey": "long", "l_suppkey": "long", "l_linenumber": "long"}


# ---------------------------------------------------------------- details

def sql_number(x: str) -> str:
    """1.234,56"""
    return f"translate(format('{{:,.2f}}', ({x})::DOUBLE), ',.', '.,')"


def sql_edge_label(x: str) -> str:
    """Three decimals, or three significant digits below 1."""
    return f"CAST(CASE WHEN {x} = 0 THEN {x} WHEN abs({x}) >= 1 THEN round({x}, 3) ELSE round({x}, CAST(2 - floor(log10(abs({x}))) AS INTEGER)) END AS VARCHAR)"


def sql_bins(c: str, right_closed: bool, most: int) -> str:
    """(bin, b, lower, upper, count) of column ``c`` of ``src``, edges not rounded."""
    if right_closed:
        edge = "CASE WHEN mn = mx THEN mn - CASE WHEN mn <> 0 THEN 0.001 * abs(mn) ELSE 0.001 END ELSE mn END AS a0, CASE WHEN mn = mx THEN mx + CASE WHEN mx <> 0 THEN 0.001 * abs(mx) ELSE 0.001 END ELSE mx END AS a1, CASE WHEN mn = mx THEN 0.0 ELSE (mx - mn) * 0.001 END AS adj"
        inside = "t.v > e.lower AND t.v <= e.upper"
    else:
        edge = "CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS a0, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS a1, 0.0 AS adj"
        inside = "t.v >= e.lower AND (t.v < e.upper OR (e.bin = e.b AND t.v <= e.upper))"
    return f"""(WITH t AS (SELECT CAST({q(c)} AS DOUBLE) AS v FROM src WHERE {q(c)} IS NOT NULL),
  s AS (SELECT min(v) AS mn, max(v) AS mx, count(DISTINCT v) AS nd FROM t),
  p AS (SELECT least({most}, greatest(1, nd)) AS b, {edge} FROM s),
  g AS (SELECT b, a0, a1, adj, (a1 - a0) / b AS step, unnest(range(1, b + 1)) AS i FROM p),
  e AS (SELECT CAST(i AS INTEGER) AS bin, b, CASE WHEN i = 1 THEN a0 - adj ELSE (i - 1) * step + a0 END AS lower,
          CASE WHEN i = b THEN a1 ELSE i * step + a0 END AS upper FROM g)
  SELECT bin, b, lower, upper, (SELECT count(*) FROM t WHERE {inside}) AS count FROM e)"""


def sql_top(c: str, k: int) -> str:
    """(place, value, cnt, valid) of the ``k`` most frequent values of column ``c`` of ``src``."""
    return f"""(SELECT row_number() OVER (ORDER BY cnt DESC, value) AS place, value, cnt, (SELECT count({q(c)}) FROM src) AS valid
  FROM (SELECT CAST({q(c)} AS VARCHAR) AS value, count(*) AS cnt FROM src WHERE {q(c)} IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, value LIMIT {k}))"""


def sql_details(source: str, columns: list[tuple[str, str]], whole: dict[str, str]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        head = f"SELECT {i} AS ordinal, {lit(c)} AS variable, {lit(kind)} AS variable_type"
        none = "CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS percent"
        if kind == NUMERIC:
            v = f"CAST({q(c)} AS DOUBLE)"
            shown = (lambda x: f"CAST(CAST({x} AS BIGINT) AS VARCHAR)") if c in whole else sql_number
            quartile = [sql_number(sql_np_quantile(c, p)) for p in (0.25, 0.5, 0.75)]
            stats = [("Mínimo", shown(f"min({v})")), ("Máximo", shown(f"max({v})")), ("Promedio", sql_number(f"avg({v})")), ("Mediana", quartile[1]),
                     ("Desv. estándar", f"CASE WHEN count({v}) <= 1 THEN '0' ELSE {sql_number(f'stddev_samp({v})')} END"),
                     ("Cuartiles", f"'Q1 ' || {quartile[0]} || ' · Q3 ' || {quartile[2]}")]
            parts.append(f"{head}, 'distribution' AS part, bin AS position, '(' || {sql_edge_label('lower')} || ', ' || {sql_edge_label('upper')} || ']' AS label, "
                         f"CAST(NULL AS VARCHAR) AS value, count, CAST(NULL AS DOUBLE) AS percent FROM {sql_bins(c, True, 5)}")
        else:
            stats = [("Valores únicos", f"CAST(count(DISTINCT {q(c)}) AS VARCHAR)"), ("Más frecuente", f"(SELECT value FROM {sql_top(c, 1)})"),
                     ("Nulos", f"CAST(count(*) - count({q(c)}) AS VARCHAR)")]
            parts.append(f"{head}, 'distribution' AS part, place AS position, value AS label, CAST(NULL AS VARCHAR) AS value, cnt AS count, "
                         f"CAST(NULL AS DOUBLE) AS percent FROM {sql_top(c, 5)}")
        parts += [f"{head}, 'stats' AS part, {place} AS position, {lit(label)} AS label, {value} AS value, {none} FROM src HAVING count(*) >= 0"
                  for place, (label, value) in enumerate(stats, start=1)]
        parts.append(f"{head}, 'percentages' AS part, place AS position, value AS label, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS count, "
                     f"round(cnt * 100.0 / valid, 1) AS percent FROM {sql_top(c, 5)}")
    return f"WITH src AS ({source})\n" + "\nUNION ALL\n".join(f"({p})" for p in parts)


@register("profile_details", sql_details(tb.LN_SQL, ln_kinds(), LN_TYPES))
def q_profile_details(spark: SparkSession, sf: str) -> DataFrame:
    """The full detail table, one row per statistic, bin and frequent value."""
    details = profile(tb.ln(spark, sf)).details_frame()
    head = ["ordinal", "variable", "variable_type"]
    parts = [
        details.select(*head, F.lit("stats").alias("part"), F.posexplode("stats").alias("at", "e")).select(
            *head, "part", (F.col("at") + 1).alias("position"), "e.label", "e.value", F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("percent")),
        details.select(*head, F.lit("distribution").alias("part"), F.posexplode("distribution").alias("at", "e")).select(
            *head, "part", (F.col("at") + 1).alias("position"), F.col("e.range").alias("label"), F.lit(None).cast("string").alias("value"), "e.count", F.lit(None).cast("double").alias("percent")),
        details.select(*head, F.lit("percentages").alias("part"), F.posexplode("percentages").alias("at", "e")).select(
            *head, "part", (F.col("at") + 1).alias("position"), F.col("e.range").alias("label"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("count"), "e.percent")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- JSON context

@register("profile_json", f"""WITH v AS ({ORACLE["profile_variables"]}), s AS ({ORACLE["profile_summary"]})
SELECT 1::BIGINT AS dataset_id, 'lineitem' AS dataset_nombre, 'lineitem.parquet' AS nombre_archivo, s.rows, s.completeness, s.outliers AS all_outliers,
  v.ordinal, v.variable, v.variable_type, v.valid, v.nulls, round(v.q2, 4) AS q2, v.outliers,
  CASE WHEN v.variable_type = 'Numérica' THEN 6 ELSE 3 END AS stats FROM v, s""")
def q_profile_json(spark: SparkSession, sf: str) -> DataFrame:
    """The compact JSON context of lineitem's profile, read back from its text, one row per variable."""
    text = profile_context(profile_tables(profile(tb.ln(spark, sf))), {"id": 1, "name": "lineitem", "file_name": "lineitem.parquet"})
    row = "ordinal int, variable string, variable_type string, valid long, nulls long, q2 double, outliers long"
    schema = (f"dataset_id long, dataset_nombre string, nombre_archivo string, resumen struct<rows:long,completeness:double,outliers:long>, "
              f"variables array<struct<{row.replace(' ', ':').replace(',:', ',')}>>, detalles_variables map<string,struct<stats:array<struct<label:string>>>>")
    doc = text.select(F.from_json("context", schema).alias("d")).select("d.*", F.explode("d.variables").alias("v"))
    return doc.select("dataset_id", "dataset_nombre", "nombre_archivo", "resumen.rows", "resumen.completeness", F.col("resumen.outliers").alias("all_outliers"),
                      "v.ordinal", "v.variable", "v.variable_type", "v.valid", "v.nulls", F.round("v.q2", 4).alias("q2"), "v.outliers",
                      F.size(F.element_at("detalles_variables", F.col("v.variable"))["stats"]).alias("stats"))


# ---------------------------------------------------------------- selection and charts

def sql_selection(source: str, columns: list[tuple[str, str]]) -> str:
    """CTEs up to ``chosen`` (position, variable, variable_type): a walk over the ranked numeric variables, then the others."""
    numeric = [c for c, kind in columns if kind == NUMERIC]
    pairs = "\nUNION ALL\n".join(f"SELECT {lit(a)} AS a, {lit(b)} AS b, corr({q(a)}::DOUBLE, {q(b)}::DOUBLE) AS r FROM src"
                                 for a in numeric for b in numeric if a != b)
    return f"""WITH RECURSIVE src AS ({source}), pv AS ({sql_profile_variables(source, columns)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY variable_type = 'Numérica' ORDER BY nulls + coalesce(outliers, 0) DESC, valid DESC, ordinal) AS k FROM pv),
close AS (SELECT a, b FROM ({pairs}) WHERE abs(r) > 0.7),
nodes AS (SELECT r.k, r.variable, coalesce(list(s.k) FILTER (WHERE s.k IS NOT NULL), []) AS like_it FROM ranked r
  LEFT JOIN close c ON c.a = r.variable LEFT JOIN ranked s ON s.variable = c.b WHERE r.variable_type = 'Numérica' GROUP BY ALL),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept
  UNION ALL SELECT n.k, CASE WHEN len(list_intersect(w.kept, n.like_it)) > 0 THEN w.kept ELSE list_append(w.kept, n.k) END FROM walk w JOIN nodes n ON n.k = w.k + 1),
last AS (SELECT kept FROM walk ORDER BY k DESC LIMIT 1),
queue AS (SELECT variable, variable_type, (variable_type <> 'Numérica')::INT AS turn, k FROM ranked, last WHERE variable_type <> 'Numérica' OR list_contains(kept, k)),
chosen AS (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY turn, k) AS INTEGER) AS position, variable, variable_type FROM queue) WHERE position <= 12)"""


def _lnc_all() -> tuple[str, list[tuple[str, str]]]:
    source = f"SELECT *, l_quantity * 2 + l_tax AS l_qty_tax, l_extendedprice * (1 - l_discount) AS l_net, 100.0 - l_quantity AS l_qty_left FROM ({tb.LN_SQL}) b"
    return source, [*ln_kinds(), *((c, NUMERIC) for c in ("l_qty_tax", "l_net", "l_qty_left"))]


@register("diverse_selection", sql_selection(*_lnc_all()) + "\nSELECT position, variable, variable_type FROM chosen")
def q_diverse_selection(spark: SparkSession, sf: str) -> DataFrame:
    return sel.selection_frame(tb.lnc_all(spark, sf))


def sql_charts(columns: list[tuple[str, str]]) -> str:
    parts = []
    for c, kind in columns:
        if kind == NUMERIC:
            parts.append(f"SELECT {lit(c)} AS variable, 'histogram' AS chart, bin AS position, '[' || CAST(lower AS VARCHAR) || ', ' || CAST(upper AS VARCHAR) "
                         f"|| CASE WHEN bin = b THEN ']' ELSE ')' END AS label, count FROM {sql_bins(c, False, 10)}")
        else:
            parts.append(f"SELECT {lit(c)} AS variable, 'bars' AS chart, CAST(row_number() OVER (ORDER BY place DESC) AS INTEGER) AS position, value AS label, "
                         f"cnt AS count FROM {sql_top(c, 8)}")
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


@register("chart_data", sql_selection(tb.LN_SQL, ln_kinds()) + f", charts AS ({sql_charts(ln_kinds())})\nSELECT charts.* FROM charts JOIN chosen USING (variable)")
def q_chart_data(spark: SparkSession, sf: str) -> DataFrame:
    df = tb.ln(spark, sf)
    return sel.chart_data(df, sel.select_diverse(df))
