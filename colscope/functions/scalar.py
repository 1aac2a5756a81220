"""Scalar column functions, all built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Label strings of the three semantic types and the blank pivot key; these are
# fixed values that must equal the reference's output.
NUMERIC = "Numérica"
TEMPORAL = "Temporal"
CATEGORICAL = "Categórica"
BLANK_KEY = "(En blanco)"
NOT_AVAILABLE = "N/D"


def col(name: str) -> Column:
    """Column by exact name (dots, spaces and backticks allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, TEMPORAL_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order (booleans excluded)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def null_or_nan(c: Column, dt: T.DataType) -> Column:
    """missing test; Spark keeps NaN apart from NULL, pandas does not."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def as_double(c: Column, dt: T.DataType) -> Column:
    """numeric value as double with NaN mapped to NULL (T5)."""
    d = c.cast("double") if is_numeric_type(dt) else c.try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def finite_double(c: Column, dt: T.DataType) -> Column:
    """As ``as_double`` with +-Infinity also NULL (T16: no fence or bin for them)."""
    d = as_double(c, dt)
    return F.when(F.abs(d) == F.lit(float("inf")), F.lit(None).cast("double")).otherwise(d)


def as_text(c: Column, dt: T.DataType) -> Column:
    """value as text; nested values as JSON."""
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None).cast(dt)).cast("string")
    return c.cast("string")


def format_number_es(c: Column) -> Column:
    """``1.234.567,89`` for floats (2 dp), ``N/D`` for null."""
    return F.coalesce(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(NOT_AVAILABLE))


def safe_name(c: Column) -> Column:
    """F8: runs outside ``[a-zA-Z0-9_-]`` become ``_``; trimmed; fallback ``dataset``."""
    stripped = F.regexp_replace(c, r"^\s+|\s+$", "")
    cleaned = F.regexp_replace(F.regexp_replace(stripped, r"[^a-zA-Z0-9_-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("dataset"))


def folder_name(c: Column) -> Column:
    """F8, folder of an owner: lower case, runs outside ``[a-zA-Z0-9._-]`` become ``_``; fallback ``usuario_sin_identificador``."""
    cleaned = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[^a-zA-Z0-9._-]+", "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("usuario_sin_identificador"))


def file_name(c: Column, lower: bool = False) -> Column:
    """F8, file of a dataset (``lower``: its folder): as ``folder_name``, without ``.``, ``_`` and ``-`` at the ends; fallback ``dataset``."""
    text = F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")) if lower else c
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("dataset"))


def format_label(c: Column) -> Column:
    """file extension without the dot, upper case (empty when none)."""
    return F.upper(F.regexp_extract(c, r"\.([^./]+)$", 1))


def json_safe(c: Column, dt: T.DataType) -> Column:
    """NaN -> null, temporal -> ISO text (microseconds only where there are any), everything else unchanged."""
    if isinstance(dt, T.TimestampType) or isinstance(dt, T.TimestampNTZType):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None).cast(dt))
    return c
