"""Upload validation: format -> non-empty -> structure, first failure wins."""

from __future__ import annotations

import os

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.sources.readers import SourceError, check_csv

# Accepted upload extensions and the messages of each rule.
UPLOAD_FORMATS = [".csv", ".xlsx"]
MSG_FORMAT = f"Formato no válido. Solo se permiten archivos {UPLOAD_FORMATS}"
MSG_EMPTY = "El archivo está completamente vacío."
MSG_CSV_SHAPE = ("El archivo CSV no tiene la estructura de una tabla. Verifique que no esté vacío "
                 "y que use comas (,) como separador.")
MSG_EXCEL_SHAPE = "El archivo Excel no parece contener una tabla de datos válida."
MSG_BROKEN = "El archivo está dañado o su estructura no es válida. Detalle: {detail}"

REPORT_SCHEMA = "step int, rule string, passed boolean, message string"


class ValidationError(ValueError):
    pass


def _extension(path: str) -> str:
    return "." + os.path.basename(path).split(".")[-1].lower()


def _size(spark: SparkSession, path: str) -> int:
    """Length of all files, summed from the file listing; the content is never read."""
    return int(spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0)


def _structure(spark: SparkSession, path: str, ext: str) -> str | None:
    """None when the whole file is a table of >= 2 columns without ragged records, else the failure message."""
    if ext != ".csv":
        return MSG_BROKEN.format(detail=MSG_EXCEL_SHAPE)
    try:
        if len(check_csv(spark, path)) < 2:
            return MSG_BROKEN.format(detail=MSG_CSV_SHAPE)
    except (SourceError, PySparkException) as exc:  # a reader error means a damaged file
        return MSG_BROKEN.format(detail=str(exc).splitlines()[0] if str(exc) else type(exc).__name__)
    return None


def validate_source(spark: SparkSession, path: str, raise_on_error: bool = False) -> DataFrame:
    """One row per rule (format, size, structure); rules after a failure are skipped."""
    report = []
    ext = _extension(path)
    ok = ext in UPLOAD_FORMATS
    report.append((1, "format", ok, None if ok else MSG_FORMAT))
    if ok:
        size = _size(spark, path)
        ok = size > 0
        report.append((2, "size", ok, None if ok else MSG_EMPTY))
    else:
        report.append((2, "size", None, None))
    if ok:
        problem = _structure(spark, path, ext)
        ok = problem is None
        report.append((3, "structure", ok, problem))
    else:
        report.append((3, "structure", None, None))
    if raise_on_error:
        for _, _, passed, message in report:
            if passed is False:
                raise ValidationError(message)
    return spark.createDataFrame(report, REPORT_SCHEMA).orderBy(F.col("step"))
