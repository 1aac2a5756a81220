"""Running totals inside groups of any size, and a table's sizes that they need.

A window over a whole group would put a hot group (one source, one language) into one task.  Here the rows
are dealt into sorted ranges, the ranges' totals give each range its offset, and a window is bounded by one range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colscope.session import Scratch

#: Aimed rows of a range, and the most ranges that are made (ranges grow beyond ``RANGE_ROWS * MOST_RANGES`` rows).
RANGE_ROWS, MOST_RANGES = 20_000, 10_000


def range_count(rows: int) -> int:
    return max(1, min(MOST_RANGES, math.ceil(rows / RANGE_ROWS)))


def running_totals(rows: DataFrame, group: list[str], order: list[Column], totals: dict[str, Column], n_rows: int, tables: Scratch) -> DataFrame:
    """``rows`` and, for each name in ``totals``, the sum of that expression over the earlier rows of the same group (0 for the first).

    ``order`` sorts inside a group; rows that are equal in it get an order of their own that holds for this result.
    NULL is a group like any other.  ``n_rows`` sets the number of ranges.  The result reads a table of ``tables``.
    """
    keys = [F.col(g) for g in group]
    dealt = (rows.withColumn("_tie", F.monotonically_increasing_id())
             .repartitionByRange(range_count(n_rows), *keys, *order, F.col("_tie")).withColumn("_range", F.spark_partition_id()))
    dealt = tables.keep(dealt)
    sums = dealt.groupBy("_range", *group).agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("_range").alias("_at"), *(F.col(g).alias(f"_of_{g}") for g in group), F.count(F.lit(1)).over(earlier).alias("_begun"),
                          *(F.sum(f"_sum_{n}").over(earlier).alias(f"_off_{n}") for n in totals))
    # Ranges are sorted, so at most the first group of a range began in an earlier one: no more rows than ranges.
    offsets = F.broadcast(offsets.where("_begun > 0").drop("_begun"))
    inside = W.partitionBy("_range", *group).orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, -1)
    local = dealt.select("*", *(F.sum(c).over(inside).alias(f"_in_{n}") for n, c in totals.items()))
    same = F.col("_range") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return local.join(offsets, same, "left").select(
        *rows.columns, *((F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n) for n in totals))
