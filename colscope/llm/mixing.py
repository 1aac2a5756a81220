"""Mixing sources to target weights by systematic sampling, in native expressions.

Sources share the mix by weight, but none gets more than ``ceiling`` times its words: what lies above goes to
the others by weight, until none is above.  In a source every document is expected the same number of times
(target / words of the source); the expected copies are summed along the documents, one random offset is added,
and a document is emitted once for each integer that its stretch of the sum crosses.  So its copies are the
expected number rounded down or up, and the sums of copies never drift.  The documents lie in descending order of
their words, which bounds the error of a source's words by those of its longest document.

All is done in whole numbers (decimals), so nothing depends on the order of summation.  No group meets in one task:
positions and shares come from running totals over sorted ranges, and a source's rate meets its documents by buckets of positions.

Defined results: NULL and empty texts have no words and are never emitted; a NULL source is a source, the last one;
a NULL id is an id like any other; rows that repeat are documents of their own; sources without words have the target 0;
empty in, empty out.  The offset is a hash of the seed and the source, ties among documents go by the MD5 of their
texts and by id: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.running import running_totals
from colscope.session import Scratch, reliable_checkpoint

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the random offset.
_BITS = 20
#: Positions of a source that share a bucket of the join with its rate.
_BUCKET = 65_536
#: Copies of a row that one array stands for while they are emitted.
_COPIES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], ceiling: int, tables: Scratch) -> DataFrame:
    """(source, source_size, docs, weight, part, parts, fixed, target) for a table (source, source_size, docs).

    A source that is not fixed has the target ``part * weight / parts``.
    """
    n = sizes.count()
    last = [F.col("source").isNull(), F.col("source")]
    placed = running_totals(sizes, [], last, {"place": F.lit(1)}, n, tables)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = tables.keep(placed.select("source", "source_size", "docs", weight.cast("long").alias("weight")))
    # Water filling: sources in ascending order of words per weight; those below the level of all later ones are full.
    common = 1
    for w in weights:
        common *= w
    level = _whole(F.col("source_size")) * F.element_at(F.array(*(F.lit(common // w) for w in weights)),
                                                        F.array_position(F.array(*(F.lit(w).cast("long") for w in weights)), F.col("weight")).cast("int"))
    ordered = running_totals(placed, [], [level, *last], {"lower_size": _whole(F.col("source_size")), "lower_weight": F.col("weight")}, n, tables)
    whole = placed.agg(F.coalesce(F.sum(_whole(F.col("source_size"))), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    total, all_weights = _whole(F.lit(whole.s)), _whole(F.lit(whole.w))
    rest, rest_weight = total - F.col("lower_size") * ceiling, all_weights - _whole(F.col("lower_weight"))
    full = _whole(F.col("source_size")) * ceiling * rest_weight < rest * _whole(F.col("weight"))
    ordered = tables.keep(ordered.select("source", "source_size", "docs", "weight", full.alias("fixed")))
    taken = ordered.where("fixed").agg(F.coalesce(F.sum(_whole(F.col("source_size"))), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    part, parts = int(whole.s) - ceiling * int(taken.s), int(whole.w) - int(taken.w)
    share = F.lit(float(part)) * F.col("weight") / F.lit(float(max(parts, 1)))
    return ordered.select("source", "source_size", "docs", "weight", "fixed", _whole(F.lit(part)).alias("part"), _whole(F.lit(parts)).alias("parts"),
                          F.when(F.col("fixed"), F.col("source_size") * F.lit(float(ceiling))).otherwise(share).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, seed: int = 0, key: str = "doc_id",
             source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, tag (hash of the text), size (words), source_size, target, copies, taken (words)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(body).alias("tag"), F.md5(body).alias("mark"), word_count(body).alias("size"))
    with Scratch() as tables:
        order = [F.col("size").desc(), F.col("mark"), F.col("doc_id")]
        placed = tables.keep(running_totals(rows, ["source"], order, {"before": F.lit(1)}, docs.count(), tables))
        sizes = tables.keep(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
        targets = source_targets(sizes, weights, ceiling, tables)
        offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))), 1, _BITS // 4), 16, 10).cast("long")
        rates = targets.select(F.col("source").alias("of"), "source_size", "target", "weight", "fixed", "part", "parts", offset.alias("offset"),
                               F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("docs") / _BUCKET))).alias("bucket"))
        bucket = F.floor(F.col("before") / _BUCKET)
        joined = placed.join(rates, F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("bucket")))
        # before * rate + offset in whole numbers, rate = part * weight / (parts * source_size)
        joined = joined.withColumn("under", _whole(F.col("parts") * F.col("source_size")) * (1 << _BITS))
        joined = joined.withColumn("gain", _whole(F.col("part") * F.col("weight")) * (1 << _BITS)).withColumn(
            "shift", _whole(F.col("parts") * F.col("source_size")) * F.col("offset"))
        copies = (F.when(F.col("source_size") == 0, 0).when(F.col("fixed"), ceiling)
                  .otherwise(F.expr("(CAST((before + 1) * gain AS decimal(38,0)) + shift) div under - (CAST(before * gain AS decimal(38,0)) + shift) div under")))
        plan = joined.select("doc_id", "source", "tag", "size", "source_size", "target", copies.cast("long").alias("copies"))
        return reliable_checkpoint(plan.withColumn("taken", F.col("copies") * F.col("size")))


def emit_mix(docs: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix: rows of ``docs``, all columns, each as often as ``plan`` says.

    Rows that agree in id, source and text cannot be told apart by the plan; one of them is emitted for all.
    """
    totals = plan.groupBy("doc_id", "source", "tag").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    body = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.`{key}`").alias("own_id"), F.col(f"row.`{source}`").cast("string").alias("own_source"),
                                                         F.xxhash64(body).alias("own_tag"))
    found = rows.join(totals, rows["own_id"].eqNullSafe(totals["doc_id"]) & rows["own_source"].eqNullSafe(totals["source"]) & (rows["own_tag"] == totals["tag"]))
    twice = found.where("rows > 1").dropDuplicates(["own_id", "own_source", "own_tag"])
    # Two steps, so that no array holds all copies of a row that stands in the table countless times.
    parts = found.where("rows = 1").unionByName(twice).select("row", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_COPIES).cast("long"))).alias("at"))
    return parts.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_COPIES), F.col("copies") - F.col("at"))))).select("row.*")
