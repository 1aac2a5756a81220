"""Report tables and the report download name (F8).

Both tables are projections of the profile tables (one row per column of the
profiled table), so they cost nothing beyond the profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.scalar import safe_name
from colscope.sources.store import load_profile

# Indicator labels in display order, the missing-outliers mark
# and the download name prefix.
INDICATORS = [
    ("rows", "Registros"),
    ("variables", "Variables"),
    ("completeness", "Completitud"),
    ("null_cells", "Registros nulos"),
    ("outliers", "Atípicos"),
]
NO_OUTLIERS = "N/A"
PROFILE_REQUIRED = "El dataset debe tener un perfilado de datos válido antes de generar el resumen ejecutivo"
REPORT_PREFIX = "resumen_ejecutivo_"


class ProfileRequired(LookupError):
    pass


def indicators(summary: DataFrame) -> DataFrame:
    """Headline indicators as (position, label, value) text rows; completeness as ``x%``."""
    cells = []
    for pos, (field, label) in enumerate(INDICATORS, start=1):
        value = F.concat(F.col(field).cast("string"), F.lit("%")) if field == "completeness" else F.col(field).cast("string")
        cells.append(F.struct(F.lit(pos).alias("position"), F.lit(label).alias("label"), value.alias("value")))
    return summary.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def appendix(variables: DataFrame) -> DataFrame:
    """Per-variable appendix: name, type, valid, nulls, outliers (``N/A`` when not numeric)."""
    return variables.select(
        "ordinal", "variable", "variable_type", "valid", "nulls",
        F.coalesce(F.col("outliers").cast("string"), F.lit(NO_OUTLIERS)).alias("outliers"),
    )


def report_tables(spark: SparkSession, store: str, dataset_id: int) -> dict[str, DataFrame]:
    """Indicators and appendix of a stored profile; without a valid one the report is refused."""
    found = load_profile(spark, store, dataset_id)
    if found is None:
        raise ProfileRequired(PROFILE_REQUIRED)
    return {"indicators": indicators(found["summary"]), "appendix": appendix(found["variables"])}


def download_names(catalog: DataFrame) -> DataFrame:
    """(id, report_file): ``resumen_ejecutivo_<safe name>.pdf`` per dataset."""
    return catalog.select("id", F.concat(F.lit(REPORT_PREFIX), safe_name(F.col("name")), F.lit(".pdf")).alias("report_file"))
