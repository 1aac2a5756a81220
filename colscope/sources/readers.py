"""Table readers; workbooks (S2) are left out, as one task would read each whole.

``read_table`` dispatches on the file extension.  CSV is read the way pandas'
``read_csv`` sees it: every field as text first, the pandas missing-value
tokens mapped to NULL, duplicate headers renamed ``a``, ``a.1``, ..., then one
aggregate decides each column's type (long, double, boolean or text; an
all-null column is double) and the columns are cast.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.scalar import col
from colscope.session import Scratch
from colscope.sources.records import csv_records, has_open_lines, text_lines

# The text tokens pandas reads as missing by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOL_TOKENS = ["True", "False", "TRUE", "FALSE", "true", "false"]
FORMATS = {".csv": "csv", ".parquet": "parquet"}
UNSUPPORTED = "Formato de archivo no soportado para perfilado"


class SourceError(ValueError):
    pass


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """S3: reader chosen by the lower-cased extension (or ``fmt``)."""
    kind = fmt or FORMATS.get(os.path.splitext(path)[1].lower())
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise SourceError(UNSUPPORTED)


def dedupe_headers(names: list[str]) -> list[str]:
    """Repeated header names become ``name``, ``name.1``, ``name.2``, ..."""
    seen: dict[str, int] = {}
    taken = set(names)
    out = []
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        k = seen[n]
        while True:
            k += 1
            cand = f"{n}.{k}"
            if cand not in taken:
                break
        seen[n] = k
        taken.add(cand)
        out.append(cand)
    return out


def _parsing(columns: int) -> dict[str, str]:
    """Options of Spark's CSV parser: quotes inside quoted fields are doubled, a record of another length is kept whole in ``_ODD``."""
    return {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _ODD, "maxColumns": str(max(20_480, 2 * columns)),
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _fields(record: str) -> list[str]:
    """The fields of one record (the header)."""
    return next(csv.reader([record.removeprefix("\ufeff")], doublequote=True), [])


def _header(names: list[str]) -> list[str]:
    return dedupe_headers([h if h != "" else f"Unnamed: {i}" for i, h in enumerate(names)])


def _surplus(bad: Column, columns: int) -> Column:
    """True for a record with more than ``columns`` fields.

    A mark is put behind the record as one field more: if the record is short, the mark is among the first fields.
    """
    mark = "\u241e-end"
    schema = ", ".join(f"c{i} string" for i in range(columns + 1))
    parsed = F.from_csv(F.concat(bad, F.lit(f",{mark}")), schema, {k: v for k, v in _parsing(columns).items() if k != "columnNameOfCorruptRecord"})
    return ~F.coalesce(F.array_contains(F.array(*(F.coalesce(parsed[f"c{i}"], F.lit("")) for i in range(columns + 1))), mark), F.lit(False))


def _checked_texts(spark: SparkSession, path: str, tables: Scratch) -> DataFrame:
    """All fields as text, missing tokens as NULL; a record with more fields than the header is refused."""
    lines = text_lines(spark, path)
    if has_open_lines(lines):
        records = tables.keep(csv_records(lines, tables))
        header = records.where("first").select("record").first()
        if not records.where(~F.col("whole")).isEmpty():
            raise SourceError("El archivo tiene un campo entre comillas sin cerrar.")
    else:
        records = None
        header = lines.where("start = 0").where(F.trim("value") != "").select("value").first()
    if header is None:
        raise SourceError("El archivo está completamente vacío.")
    names = _header(_fields(header[0].removesuffix("\r")))
    plain = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*plain, _ODD])
    if records is None:
        raw = spark.read.options(**_parsing(len(names)), header="true").schema(schema).csv(path)
    else:
        raw = records.where(~F.col("first")).select(F.from_csv("record", schema, _parsing(len(names))).alias("r"), "record")
        raw = raw.select(*(F.col(f"r.{c}").alias(c) for c in plain), F.when(F.col(f"r.{_ODD}").isNotNull(), F.col("record")).alias(_ODD))
    text = tables.keep(raw.select(*[F.when(col(p).isin(PANDAS_NA_TOKENS), None).otherwise(col(p)).alias(n) for p, n in zip(plain, names)], col(_ODD)))
    longer = text.where(col(_ODD).isNotNull()).where(_surplus(col(_ODD), len(names))).count()
    if longer:
        raise SourceError(f"El archivo tiene {longer} registros con más campos que el encabezado.")
    return text.drop(_ODD)


def check_csv(spark: SparkSession, path: str) -> list[str]:
    """The column names of a readable CSV table; a ragged, unclosed or empty one raises ``SourceError``."""
    with Scratch() as tables:
        return _checked_texts(spark, path, tables).columns


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, comma, pandas missing tokens, pandas-like type inference; a record with more fields than the header is refused.

    Files are read by as many tasks as they have splits.  Where a line may end inside quotes, records are put together first
    (``colscope.sources.records``); all other files are parsed as they are read.  The fields are parsed once, into a Parquet
    table of texts from which the types follow, and the typed table is written once: later passes read Parquet, not CSV.
    A short record is filled with NULL; blank lines are skipped; a quote that never closes is an error.
    """
    with Scratch() as tables:
        return tables.result(infer_types(_checked_texts(spark, path, tables)))


#: Column that holds a record of another length than the header's; fixed value: what a number looks like (no type suffix).
_ODD = "__odd_record__"
NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|inf|Inf|infinity|Infinity)\s*$"


def infer_types(text: DataFrame) -> DataFrame:
    """One aggregate over all text columns decides long / double / boolean / text."""
    names = text.columns
    checks = [F.count(F.lit(1)).alias("n")]
    for i, n in enumerate(names):
        c = col(n)
        number = c.rlike(NUMBER)
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count(F.when(number, c.try_cast("long"))).alias(f"l{i}"),
            F.count(F.when(number, c.try_cast("double"))).alias(f"d{i}"),
            F.count_if(c.isin(BOOL_TOKENS)).alias(f"b{i}"),
        ]
    r = text.agg(*checks).first()
    out = []
    for i, n in enumerate(names):
        nn, nl, nd, nb = r[f"n{i}"], r[f"l{i}"], r[f"d{i}"], r[f"b{i}"]
        c = col(n)
        if nn == 0:
            out.append(c.cast("double").alias(n))          # T3: all-null column is numeric
        elif nl == nn:
            out.append(c.try_cast("long").alias(n))
        elif nd == nn:
            out.append(c.try_cast("double").alias(n))
        elif nb == nn:
            out.append((F.lower(c) == "true").alias(n))
        else:
            out.append(c)
    return text.select(*out)
