"""Profile store.

A save writes the three profile tables into a folder of a new version and then commits it with one manifest row: its file
appears whole or not at all, so a save that fails on the way leaves the profile before it, and a reader never sees tables of
two saves.  The manifest with the highest version counts (update-or-insert by dataset); the version before it is
kept for readers that still hold it, older ones are deleted.  A missing or unreadable profile means "recompute and save once".
"""

from __future__ import annotations

import datetime
import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.operators.profile import Profile, profile
from colscope.session import delete_path

TABLES = ("summary", "variables", "details")
#: Error conditions of a table that is missing or is no readable Parquet.
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER")
RECORD_SCHEMA = "dataset_id long, version long, path string, size_mb double, saved_at timestamp"


def profile_tables(prof: Profile) -> dict[str, DataFrame]:
    return {"summary": prof.summary_frame(), "variables": prof.variables_frame(), "details": prof.details_frame()}


def _absent(error: PySparkException) -> bool:
    """Only "not there" and "not readable as Parquet" mean that there is no profile; all else is a failure."""
    return str(error.getCondition() or "").startswith(ABSENT)


def _folder(store: str, dataset_id: int) -> str:
    return f"{store.rstrip('/')}/dataset_id={dataset_id}"


def _records(spark: SparkSession, store: str, dataset_id: int) -> list:
    """The committed saves of a dataset, the newest first."""
    try:
        return spark.read.schema(RECORD_SCHEMA).parquet(f"{_folder(store, dataset_id)}/manifest/*").orderBy(F.desc("version")).collect()
    except PySparkException as error:
        if _absent(error):
            return []
        raise


def profile_record(spark: SparkSession, store: str, dataset_id: int) -> DataFrame:
    """The registry row of the dataset's profile (path, size in MB with 6 decimals, date of the save); no row if there is none."""
    return spark.createDataFrame(_records(spark, store, dataset_id)[:1], RECORD_SCHEMA)


def save_profile(tables: dict[str, DataFrame], store: str, dataset_id: int) -> int:
    """The version under which the tables are saved; it replaces the one before."""
    spark, folder = tables["summary"].sparkSession, _folder(store, dataset_id)
    known = _records(spark, store, dataset_id)
    version = known[0].version + 1 if known else 1
    path = f"{folder}/version={version}"
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0]
    row = (dataset_id, version, path, round((size or 0) / 1024 ** 2, 6), datetime.datetime.now())
    # The commit: one file, and an error if another save took the version meanwhile.
    spark.createDataFrame([row], RECORD_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest/{version}")
    for old in known[1:]:
        delete_path(spark, f"{folder}/manifest/{old.version}")
        delete_path(spark, old.path)
    return version


def load_profile(spark: SparkSession, store: str, dataset_id: int) -> dict[str, DataFrame] | None:
    """The tables of the dataset's last committed save, or None when there is none or it is unreadable."""
    known = _records(spark, store, dataset_id)
    if not known:
        return None
    try:
        found = {name: spark.read.parquet(f"{known[0].path}/{name}") for name in TABLES}
        return None if any(t.isEmpty() for t in found.values()) else found
    except PySparkException as error:
        if _absent(error):
            return None
        raise


def load_or_compute_profile(spark: SparkSession, store: str, dataset_id: int, df: DataFrame) -> dict[str, DataFrame]:
    """Reuse the stored profile; otherwise compute it, save it once, read it back."""
    found = load_profile(spark, store, dataset_id)
    if found is not None:
        return found
    save_profile(profile_tables(profile(df)), store, dataset_id)
    return load_profile(spark, store, dataset_id)


def stored_answer(spark: SparkSession, store: str, dataset_id: int, variable: str | None = None) -> DataFrame | None:
    """The stored profile as one row: summary, variables, the detail of one variable, its name and the date of the save."""
    tables = load_profile(spark, store, dataset_id)
    if tables is None:
        return None
    # One row per profiled column: each side is a single row of a few numbers a column.
    whole = [tables["summary"].select(F.struct("*").alias("summary")),
             tables["variables"].agg(F.sort_array(F.collect_list(F.struct("ordinal", F.struct("*").alias("v")))).alias("v")).select(F.transform("v", lambda v: v["v"]).alias("variables")),
             variable_detail(tables["details"], variable).select(F.struct("*").alias("detail"), F.col("variable").alias("selected")),
             profile_record(spark, store, dataset_id).select("saved_at")]
    out = whole[0]
    for side in whole[1:]:
        out = out.join(F.broadcast(side), F.lit(True))
    return out


def variable_detail(details: DataFrame, variable: str | None = None) -> DataFrame:
    """The requested variable's detail, else (also when unknown) the first variable's."""
    if variable:
        hit = details.where(F.col("variable") == variable)
        if not hit.isEmpty():
            return hit
    return details.where(F.col("ordinal") == 0)


def profile_context(tables: dict[str, DataFrame], dataset: dict) -> DataFrame:
    """The profile as one compact JSON document (one row, column ``context``).

    Fields: dataset_id, dataset_nombre, nombre_archivo, resumen, variables and
    detalles_variables (variable -> detail).  The inputs are profile tables,
    one row per column of the profiled table, so the document is assembled
    from their rows; no data row is involved.
    """
    spark = tables["summary"].sparkSession
    summary = tables["summary"].first().asDict(recursive=True)
    variables = [r.asDict(recursive=True) for r in tables["variables"].orderBy("ordinal").collect()]
    details = {r["variable"]: r.asDict(recursive=True) for r in tables["details"].orderBy("ordinal").collect()}
    doc = {
        "dataset_id": dataset.get("id"), "dataset_nombre": dataset.get("name"),
        "nombre_archivo": dataset.get("file_name"), "resumen": summary, "variables": variables,
        "detalles_variables": details,
    }
    text = json.dumps(doc, ensure_ascii=False, separators=(",", ":"), default=str)
    return spark.createDataFrame([(text,)], "context string")
