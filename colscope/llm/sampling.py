"""Bounded samples of labelled rows, for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash classes that a sample is cut from.
_CLASSES = 1 << 20


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows if there are no more than ``bound``; else about 0.9 * ``bound`` of them, by a hash of ``key``; never more."""
    n = rows.count()
    if n <= bound:
        return rows
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(_CLASSES))
    return rows.where(part < int(_CLASSES * 0.9 * bound / n)).limit(bound)
