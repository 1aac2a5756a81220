"""Semantic type of every column (numeric -> temporal -> parse ratio -> categorical)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.scalar import (
    CATEGORICAL, NUMERIC, TEMPORAL, col, is_numeric_type, is_temporal_type,
)

# The date layouts tried on text columns, as
# (Spark datetime pattern, equivalent strptime pattern used by the SQL oracle).
DATE_FORMATS = [
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("dd/MM/yyyy", "%d/%m/%Y"),
    ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"),
    ("dd-MM-yyyy", "%d-%m-%Y"),
]

# The shape each layout needs, checked before parsing: a failed parse is
# costly (tens of seconds per million rows), a failed regex match is not.
_D2, _D4, _HMS = r"\d{2}", r"\d{4}", r"\d{2}:\d{2}:\d{2}"
SHAPES = {
    "yyyy-MM-dd": f"^{_D4}-{_D2}-{_D2}$",
    "yyyy-MM-dd HH:mm:ss": f"^{_D4}-{_D2}-{_D2} {_HMS}$",
    "yyyy-MM-dd HH:mm": f"^{_D4}-{_D2}-{_D2} {_D2}:{_D2}$",
    "yyyy-MM-dd'T'HH:mm:ss": f"^{_D4}-{_D2}-{_D2}T{_HMS}$",
    "yyyy-MM-dd HH:mm:ss.SSSSSS": f"^{_D4}-{_D2}-{_D2} {_HMS}\\.\\d{{6}}$",
    "yyyy/MM/dd": f"^{_D4}/{_D2}/{_D2}$",
    "MM/dd/yyyy": f"^{_D2}/{_D2}/{_D4}$",
    "dd/MM/yyyy": f"^{_D2}/{_D2}/{_D4}$",
    "MM/dd/yyyy HH:mm:ss": f"^{_D2}/{_D2}/{_D4} {_HMS}$",
    "dd-MM-yyyy": f"^{_D2}-{_D2}-{_D4}$",
}
TEMPORAL_RATIO = 0.8
#: Characters of the longest layout.
_LONGEST = 26


def parsed(c: Column, pattern: str) -> Column:
    """Timestamp of ``c`` under ``pattern``, or null; the shape is checked first."""
    return F.when(c.rlike(SHAPES[pattern]), F.try_to_timestamp(c, F.lit(pattern)))


#: Text columns typed by one aggregate.
_BATCH = 8


def parse_counts(df: DataFrame, columns: list[str]) -> dict[str, list[int]]:
    """Per text column: [non-null values, values that parse under layout 0, layout 1, ...].

    Counts of rows in one aggregate without a grouping key for every eight columns: tasks send one row each, no value is shuffled.
    A value that does not begin with two digits, or is longer than any layout, is out before a pattern is tried.
    """
    out = {}
    for start in range(0, len(columns), _BATCH):
        chunk = columns[start:start + _BATCH]
        likely = [F.when((F.length(col(c)) <= _LONGEST) & col(c).rlike(r"^\d\d"), col(c)).alias(f"t{i}") for i, c in enumerate(chunk)]
        rows = df.select(*likely, *(col(c).isNotNull().alias(f"has{i}") for i, c in enumerate(chunk)))
        got = rows.agg(*(e for i in range(len(chunk)) for e in (
            F.count_if(f"has{i}"), *(F.count(parsed(F.col(f"t{i}"), pattern)) for pattern, _ in DATE_FORMATS)))).first()
        width = len(DATE_FORMATS) + 1
        out.update({c: list(got[i * width:(i + 1) * width]) for i, c in enumerate(chunk)})
    return out


def kind_of(dt: T.DataType, counts: list[int] | None) -> str:
    """X1 rule: numeric -> temporal type -> text of which >= 80 % parses -> categorical.

    ``counts`` = [non-null, parsed under layout 0, layout 1, ...] for text columns.
    """
    if is_numeric_type(dt):
        return NUMERIC
    if is_temporal_type(dt):
        return TEMPORAL
    if isinstance(dt, T.StringType) and counts and counts[0]:
        if max(counts[1:]) / counts[0] >= TEMPORAL_RATIO:
            return TEMPORAL
    return CATEGORICAL


def semantic_types(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) in schema order; text columns by the share of values that parse as dates."""
    fields = df.schema.fields
    parse = parse_counts(df, [f.name for f in fields if isinstance(f.dataType, T.StringType)])
    return [(f.name, kind_of(f.dataType, parse.get(f.name))) for f in fields]
