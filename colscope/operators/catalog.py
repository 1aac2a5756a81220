"""Dataset catalog reads.

The catalog is a DataFrame with the registry columns
(id, name, description, file_name, path, size_bytes, uploaded_at, owner_id).
Every read is owner-scoped: another owner's id is indistinguishable from a
missing one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.scalar import format_label
from colscope.operators.ranks import running_before

AVAILABLE = "Disponible"


#: Fixed value: address of a dataset's report.
REPORT_URL = "/resumen/datasets/%s/pdf"


class NotFound(LookupError):
    pass


def owned(catalog: DataFrame, owner_id) -> DataFrame:
    """Only the owner's rows (the filter reaches the scan)."""
    return catalog.where(F.col("owner_id") == F.lit(owner_id))


def basename(path_col):
    return F.element_at(F.split(path_col, "/"), -1)


def list_datasets(catalog: DataFrame, owner_id, reports: DataFrame | None = None) -> DataFrame:
    """X11: the owner's datasets, newest first, with display name, format and report flag.

    ``reports`` (optional) holds the ids (column ``id``) that have a summary
    report; the flag is a left-semi style lookup, planned by Spark.
    """
    mine = owned(catalog, owner_id)
    shown = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), basename(F.col("path")))
    out = mine.select(
        "id", "name", "description", shown.alias("file_name"), "size_bytes", "uploaded_at",
        format_label(shown).alias("format"), F.lit(AVAILABLE).alias("state"),
    )
    if reports is not None:
        flags = reports.select("id").distinct().withColumn("report_available", F.lit(True))
        out = out.join(flags, "id", "left").withColumn(
            "report_available", F.coalesce(F.col("report_available"), F.lit(False)))
    else:
        out = out.withColumn("report_available", F.lit(False))
    # The report's address is there when the report is.
    out = out.withColumn("report_url", F.when(F.col("report_available"), F.format_string(REPORT_URL, F.col("id").cast("string"))))
    return out.orderBy(F.col("uploaded_at").desc(), F.col("id").desc())


def list_all_datasets(catalog: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """X11 for every owner at once: each owner's datasets with their newest-first position.

    Positions come from the distributed running counts keyed by owner, so an
    owner holding a large share of the catalog is spread over many tasks
    rather than sorted in one window partition.
    """
    shown = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), basename(F.col("path")))
    base = catalog.select(
        "owner_id", "id", "name", shown.alias("file_name"), "size_bytes", "uploaded_at",
        format_label(shown).alias("format"),
    )
    if reports is not None:
        flags = reports.select("id").distinct().withColumn("report_available", F.lit(True))
        base = base.join(flags, "id", "left").withColumn(
            "report_available", F.coalesce(F.col("report_available"), F.lit(False)))
    else:
        base = base.withColumn("report_available", F.lit(False))
    micros = F.unix_micros(F.col("uploaded_at").cast("timestamp"))
    newest_first = F.struct(
        F.coalesce(-micros, F.lit(2 ** 63 - 1)).alias("t"),     # newest first, undated last
        (-F.col("id")).alias("i"),
    )
    ranked = running_before(
        base.withColumn("_k", newest_first).withColumn("_one", F.lit(1).cast("long")),
        ["owner_id"], "_k", "_one", out="_before")
    return ranked.withColumn("position", (F.col("_before") + 1).cast("int")).drop("_k", "_one", "_before")


def get_dataset(catalog: DataFrame, dataset_id, owner_id) -> dict:
    """Single owner-scoped lookup; raises NotFound for a foreign or missing id."""
    rows = owned(catalog, owner_id).where(F.col("id") == F.lit(dataset_id)).limit(1).collect()
    if not rows:
        raise NotFound("Dataset no encontrado")
    return rows[0].asDict()
