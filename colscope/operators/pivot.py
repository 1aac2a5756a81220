"""Validated multi-key pivot table.

Plan: group on row keys + column keys and aggregate (one shuffle, map-side
partial aggregation; ``median`` goes through the distributed rank machinery,
``count`` is a two-phase distinct count), drop groups whose aggregate is null,
then spread the column keys with ``pivot`` over the collected, sorted list of
observed column-key combinations (bounded by ``spark.sql.pivotMaxValues``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.scalar import BLANK_KEY, col, is_numeric_type
from colscope.operators.ranks import exact_quantiles
from colscope.session import reliable_checkpoint

# The accepted aggregate names; ``count`` means distinct count.
FUNCTIONS = ["sum", "mean", "count", "max", "min", "median"]
NUMERIC_ONLY = ["sum", "mean", "median"]
HEADER_SEPARATOR = " - "
SAME_HEADER = "Varias combinaciones de columnas dan el mismo encabezado"
RESERVED_HEADER = "Encabezado reservado"


class PivotError(ValueError):
    """A rule V1-V7 failed, or the pivot produced no rows."""


def validate_pivot(df: DataFrame, rows: list[str], columns: list[str], value: str, function: str) -> None:
    """V1-V7 on the schema only; no Spark job runs."""
    if not rows:
        raise PivotError("Debe seleccionar al menos una variable en 'Dimensiones de Fila'.")
    if function not in FUNCTIONS:
        raise PivotError(f"La función '{function}' no es válida. Opciones permitidas: {FUNCTIONS}")
    names = df.columns
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise PivotError(f"El archivo cargado tiene columnas con nombres duplicados: {dupes}.")
    for name in list(rows) + list(columns) + [value]:
        if name not in names:
            raise PivotError(f"La variable '{name}' no existe en el dataset.")
    dtype = df.schema[value].dataType
    if function in NUMERIC_ONLY and not is_numeric_type(dtype):
        raise PivotError(f"No puedes calcular '{function}' sobre '{value}' porque contiene texto. Usa 'count'.")
    shared = [n for n in rows if n in set(columns)]
    if shared:
        raise PivotError(f"Colisión detectada: La variable '{shared[0]}' no puede estar en filas y columnas al mismo tiempo.")
    if value in rows or value in columns:
        raise PivotError("Error de estructura: la variable de valores no puede usarse también como dimensión.")


def _aggregate(grouped_df: DataFrame, keys: list[str], value_col, function: str, value_type: T.DataType) -> DataFrame:
    """(keys..., agg) per observed key combination; null aggregates dropped."""
    v = value_col
    if isinstance(value_type, (T.FloatType, T.DoubleType)):
        v = F.nanvl(v, F.lit(None).cast(value_type))
    if function == "median":
        long = grouped_df.select(*keys, v.cast("double").alias("_v"))
        med = exact_quantiles(long, keys, "_v", [0.5]).select(*keys, F.col("quantile").alias("agg"))
        return med.where(F.col("agg").isNotNull())
    if function == "sum":
        agg = F.coalesce(F.sum(v), F.lit(0).cast(_sum_type(value_type)))
    elif function == "mean":
        agg = F.avg(v.cast("double"))
    elif function == "count":
        agg = F.count_distinct(v)
    elif function == "max":
        agg = F.max(v)
    else:
        agg = F.min(v)
    return grouped_df.groupBy(*keys).agg(agg.alias("agg")).where(F.col("agg").isNotNull())


def _sum_type(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(dt, T.DecimalType):
        return "decimal(38,%d)" % dt.scale
    return "double"


def _key(name: str, dtype: T.DataType):
    """A key column as it is grouped: blanks of text keys are filled first, so they merge with the marker itself; NaN is no value."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(col(name), F.lit(BLANK_KEY))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(col(name), F.lit(None).cast(dtype))
    return col(name)


def _grouped(df: DataFrame, keys: list[str], value: str, function: str) -> tuple[DataFrame, list[str]]:
    fields = {f.name: f.dataType for f in df.schema.fields}
    internal = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[_key(k, fields[k]).alias(a) for k, a in zip(keys, internal)], col(value).alias("_val"))
    return _aggregate(base, internal, F.col("_val"), function, fields[value]), internal


def _header(columns: list[str]):
    return F.concat_ws(HEADER_SEPARATOR, *[
        F.nullif(F.coalesce(F.col(a).cast("string"), F.lit(BLANK_KEY)), F.lit("")) for a in columns])


def pivot_long(df: DataFrame, rows: list[str], columns: list[str], value: str, function: str) -> DataFrame:
    """The pivot's cells as rows (row keys as text, ``header``, ``value``): no bound on the number of column keys."""
    validate_pivot(df, rows, columns, value, function)
    grouped, internal = _grouped(df, list(rows) + list(columns), value, function)
    shown = [F.coalesce(F.col(a).cast("string"), F.lit(BLANK_KEY)).alias(k) for a, k in zip(internal, rows)]
    return grouped.select(*shown, _header(internal[len(rows):]).alias("header"), F.col("agg").alias("value"))


def pivot_table(df: DataFrame, rows: list[str], columns: list[str], value: str, function: str) -> DataFrame:
    """pandas-style ``pivot_table`` re-expressed as grouped aggregate + pivot.

    Null keys become ``(En blanco)``; numeric result cells missing after the
    pivot become 0 and text cells ``""``; headers of several column keys are
    joined with `` - ``, empty parts skipped; rows sorted by the row keys.
    """
    validate_pivot(df, rows, columns, value, function)
    keys = list(rows) + list(columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    # materialised once: the two small metadata reads and the final spread
    # below then read the aggregate, never the input again
    grouped, internal = _grouped(df, keys, value, function)
    grouped = reliable_checkpoint(grouped)
    row_internal = internal[:len(rows)]
    col_internal = internal[len(rows):]
    header_text = _header(col_internal)
    # one small job: the observed column-key combinations with their header
    # text, plus whether each row key holds nulls (bounded by pivotMaxValues)
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    meta = (
        grouped.groupBy(*col_internal)
        .agg(*[F.max(F.col(a).isNull()).alias(f"null_{a}") for a in row_internal],
             F.first(header_text).alias("_h"))
        .limit(limit + 1).collect()
    )
    if len(meta) > limit:
        raise PivotError(f"Más de {limit} combinaciones de columnas; reduzca las dimensiones de columna.")
    has_null = {a: any(r[f"null_{a}"] for r in meta) for a in row_internal}
    has_null.update({a: any(r[a] is None for r in meta) for a in col_internal})
    display = []
    for k, a in zip(keys, internal):
        dt = fields[k]
        if isinstance(dt, T.StringType):
            display.append(F.coalesce(F.col(a), F.lit(BLANK_KEY)).alias(a))
        elif has_null[a]:
            display.append(F.coalesce(F.col(a).cast("string"), F.lit(BLANK_KEY)).alias(a))
        else:
            display.append(F.col(a))
    agg_type = grouped.schema["agg"].dataType
    fill = "" if isinstance(agg_type, T.StringType) else 0
    sort_cols = _sort_exprs(rows, fields, row_internal)

    if not columns:
        out = grouped.select(*display, "agg", F.struct(*sort_cols).alias("_o")).orderBy("_o").drop("_o")
        return out.select(*[F.col(a).alias(k) for a, k in zip(row_internal, rows)], F.col("agg").alias(value))

    text_key = [isinstance(fields[k], T.StringType) for k in columns]

    def sort_key(r):
        # text keys: plain text order (the marker included); other keys: values, then the marker
        return tuple(
            (0, BLANK_KEY if r[a] is None else r[a]) if is_text else ((1, "") if r[a] is None else (0, r[a]))
            for a, is_text in zip(col_internal, text_key)
        )

    headers = [r["_h"] for r in sorted(meta, key=sort_key)]
    if len(set(headers)) < len(headers):
        same = sorted({h for h in headers if headers.count(h) > 1})
        raise PivotError(f"{SAME_HEADER}: {same}")
    if clash := sorted(set(headers) & (set(internal) | {"_o", "_h", "agg"})):
        raise PivotError(f"{RESERVED_HEADER}: {clash}")
    wide = (
        grouped.withColumn("_h", header_text)
        .groupBy(*row_internal).pivot("_h", headers).agg(F.first("agg"))
    )
    cells = [F.coalesce(F.col(f"`{h}`"), F.lit(fill).cast(agg_type)).alias(h) for h in headers]
    row_display = [d for d, a in zip(display, internal) if a in row_internal]
    out = wide.select(*row_display, *cells, F.struct(*sort_cols).alias("_o")).orderBy("_o").drop("_o")
    return out.select(*[F.col(a).alias(k) for a, k in zip(row_internal, rows)], *[F.col(f"`{h}`") for h in headers])


def _sort_exprs(names, fields, internal):
    out = []
    for k, a in zip(names, internal):
        if isinstance(fields[k], T.StringType):
            out.append(F.coalesce(F.col(a), F.lit(BLANK_KEY)).alias(f"s{a}"))
        else:
            out.append(F.col(a).isNull().alias(f"n{a}"))
            out.append(F.col(a).alias(f"s{a}"))
    return out


def pivot_report(df: DataFrame, rows: list[str], columns: list[str], value: str, function: str) -> DataFrame:
    """Service order: validate -> pivot -> empty check."""
    out = pivot_table(df, rows, columns, value, function)
    if out.isEmpty():
        raise PivotError("La combinación seleccionada no arrojó ningún resultado válido.")
    return out
