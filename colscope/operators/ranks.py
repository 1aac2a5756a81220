"""Distributed running counts over sorted values, and what is built on them.

The one primitive here is ``running_before``: for rows unique per
``(keys, order)`` it adds the total weight of the rows with the same keys and a
smaller ``order`` value.  A plain ``sum() over (partition by keys order by v)``
would put every distinct value of a column into one task; instead:

1. range-partition the rows on ``(keys, order)`` (balanced by sampling, so a
   huge column spreads over many tasks), tag each row with its partition and
   checkpoint to the shared checkpoint folder.  The two uses below must see
   the same tags; relying on exchange reuse is not enough (column pruning
   can give the two branches different exchanges, hence different sampled
   range bounds), and a checkpoint also survives the loss of an executor;
2. per ``(partition, keys)`` total -> a table with at most
   ``partitions + distinct keys`` rows; a window over it gives each range the
   weight of all ranges before it;
3. a window bounded by one range gives the local running sum.

Exact quantiles (A6), average ranks (C3), dense ranks and the Kendall
discordance count (C4) and deep paging (L1) all use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.session import Scratch, reliable_checkpoint


def range_tag(rows: DataFrame, keys: list[str], order: str, partitions: int | None = None, tables: Scratch | None = None) -> DataFrame:
    """Step 1: range-partition on (keys, order), tag rows with their range, checkpoint.

    Without an explicit count the ranges follow ``spark.sql.shuffle.partitions``
    and adaptive execution may merge small neighbours; merged ranges stay in
    value order, so the tags still order the ranges.  ``tables`` deletes the written rows at its end; without it they
    stay until ``settled`` or the end of the driver.
    """
    by = [F.col(k) for k in keys] + [F.col(order)]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return (tables.keep if tables else reliable_checkpoint)(ranged.withColumn("_pid", F.spark_partition_id()))


def running_before_tagged(
    tagged: DataFrame,
    keys: list[str],
    order: str,
    weight: str,
    out: str = "before",
    total: str | None = None,
) -> DataFrame:
    """Steps 2-3 on rows tagged by :func:`range_tag`."""
    per_range = tagged.groupBy("_pid", *keys).agg(F.sum(weight).alias("_w"))
    by_key = Window.partitionBy(*keys)
    ranges = per_range.select(
        "_pid", *keys,
        F.coalesce(
            F.sum("_w").over(by_key.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
        *([F.sum("_w").over(by_key).alias(total)] if total else []),
    )
    local = Window.partitionBy("_pid", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    a = tagged.withColumn("_loc", F.coalesce(F.sum(weight).over(local), F.lit(0))).alias("a")
    b = ranges.alias("b")
    # null-safe key match: a null key (e.g. a blank pivot group) is a key like any other
    cond = [F.col("a._pid") == F.col("b._pid")] + [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    extra = [F.col(f"b.{total}")] if total else []
    return (
        a.join(b, cond)
        .select("a.*", F.col("b._off"), *extra)
        .withColumn(out, F.col("_off") + F.col("_loc"))
        .drop("_pid", "_off", "_loc")
    )


def running_before(
    rows: DataFrame,
    keys: list[str],
    order: str,
    weight: str,
    out: str = "before",
    total: str | None = None,
    partitions: int | None = None,
    tables: Scratch | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over rows with equal keys and smaller ``order``.

    ``total`` (optional) names a column with the key's whole weight.
    """
    return running_before_tagged(range_tag(rows, keys, order, partitions, tables), keys, order, weight, out, total)


def value_counts(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, cnt) for non-null values; partial aggregation map-side."""
    return long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def average_ranks(counts: DataFrame, keys: list[str], value: str, weight: str = "cnt") -> DataFrame:
    """pandas ``rank(method='average')``: rows below + (ties + 1) / 2."""
    ranked = running_before(counts, keys, value, weight)
    return ranked.withColumn("rank", F.col("before") + (F.col(weight) + F.lit(1)) / F.lit(2.0))


def dense_ranks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """0-based dense rank of each distinct value within its keys."""
    ones = counts.withColumn("_one", F.lit(1).cast("long"))
    return running_before(ones, keys, value, "_one", out="dense").drop("_one")


def exact_quantiles(long: DataFrame, key, value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key (numpy/pandas default rule).

    ``long`` holds (key..., value) rows; ``key`` is one column name or a list.
    Returns (key..., p, quantile). Only rows that hold a target position
    survive the filter, so the final groupBy is tiny.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = value_counts(long, keys, value)
    ranked = running_before(counts, keys, value, "cnt", total="n")
    pos = (F.col("n") - 1)
    targets = F.array(*[
        F.struct(
            F.lit(float(p)).alias("p"),
            F.floor(pos * F.lit(float(p))).cast("long").alias("lo"),
            F.least(F.ceil(pos * F.lit(float(p))).cast("long"), pos).alias("hi"),
            (pos * F.lit(float(p)) - F.floor(pos * F.lit(float(p)))).alias("frac"),
        )
        for p in probs
    ])
    start, end = F.col("before"), F.col("before") + F.col("cnt")
    in_lo = (F.col("t.lo") >= F.col("s")) & (F.col("t.lo") < F.col("e"))
    in_hi = (F.col("t.hi") >= F.col("s")) & (F.col("t.hi") < F.col("e"))
    hits = (
        ranked.select(*keys, value, start.alias("s"), end.alias("e"), F.explode(targets).alias("t"))
        .where(in_lo | in_hi)
    )
    agg = hits.groupBy(*keys, F.col("t.p").alias("p")).agg(
        F.max(F.when(in_lo, F.col(value))).alias("vlo"),
        F.max(F.when(in_hi, F.col(value))).alias("vhi"),
        F.max("t.frac").alias("frac"),
    )
    # numpy's lerp: a + t(b-a) below one half, b - (b-a)(1-t) from one half on
    lerp = F.when(
        F.col("frac") < 0.5, F.col("vlo") + F.col("frac") * (F.col("vhi") - F.col("vlo"))
    ).otherwise(F.col("vhi") - (F.col("vhi") - F.col("vlo")) * (F.lit(1.0) - F.col("frac")))
    return agg.select(*keys, "p", F.when(F.col("frac") == 0, F.col("vlo")).otherwise(lerp).alias("quantile"))
