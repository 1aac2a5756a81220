"""Distinct counts, modes and top-k tables of all columns at once, without their texts in a shuffle.

1. One pass counts (column, 128-bit hash, first characters): keys of bounded width, however long the texts.  Map-side
   combine leaves a task one row per distinct value.
2. A column's k best by (count, value) are read off that table.  The first characters order the values as the values
   themselves do, so only values that share count and first characters with the k-th place stay undecided.
3. A second, filtered read fetches the texts of the winners: one aggregate without a grouping key.
4. Where the k-th place is undecided, a third read takes the rows with those first characters, keeps the undecided values (a
   filter against the smaller side of the count table) and sends at most k of them per task.

Two different values would have to agree in two 64-bit hashes to be taken for one (about n^2 / 2^129 for n distinct values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.scalar import as_text, col
from colscope.session import Scratch

#: Characters of a value that the count table holds; a shorter value is there as a whole.
PREFIX = 12
#: Hashes that are sent to all tasks (16 bytes each).
BROADCAST_HASHES = 1_000_000
#: Winners fetched by one aggregate.
_FETCH = 100
_KEY = ("vi", "h1", "h2")


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(vi, value): every non-null value as text."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*(F.struct(F.lit(i).alias("vi"), as_text(col(c), dtypes[c]).alias("value")) for i, c in enumerate(columns)))
    return df.select(F.explode(cells).alias("e")).select("e.*").where(F.col("value").isNotNull())


def _hashes(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def hashed_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(vi, h1, h2, pre, cnt): how often each value of a column occurs, by hash and first characters."""
    h1, h2 = _hashes(F.col("value"))
    rows = _values(df, columns).select("vi", h1.alias("h1"), h2.alias("h2"), F.substring("value", 1, PREFIX).alias("pre"))
    return rows.groupBy(*_KEY, "pre").agg(F.count(F.lit(1)).alias("cnt"))


def _winners(counts: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("vi").orderBy(F.desc("cnt"), "pre", "h1", "h2")
    return counts.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= k)


def _fetched(df: DataFrame, columns: list[str], wanted: list) -> dict[tuple, str]:
    """The texts of (vi, h1, h2) keys: one aggregate a batch, map-side maxima of single values."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    found = {}
    for start in range(0, len(wanted), _FETCH):
        batch = wanted[start:start + _FETCH]
        used = sorted({r.vi for r in batch})
        named = df.select(*(as_text(col(columns[i]), dtypes[columns[i]]).alias(f"c{i}") for i in used))
        named = named.select("*", *(h.alias(f"h{n}_{i}") for i in used for n, h in zip((1, 2), _hashes(F.col(f"c{i}")))))
        texts = named.agg(*(F.max(F.when((F.col(f"h1_{r.vi}") == r.h1) & (F.col(f"h2_{r.vi}") == r.h2), F.col(f"c{r.vi}"))) for r in batch)).first()
        found.update({(r.vi, r.h1, r.h2): text for r, text in zip(batch, texts)})
    return found


def _undecided(df: DataFrame, columns: list[str], counts: DataFrame, edge, slots: int) -> list[str]:
    """The ``slots`` smallest values among those that share count and first characters with ``edge``, the k-th place."""
    near = counts.where((F.col("vi") == edge.vi) & (F.col("pre") == edge.pre))
    tied, others = near.where(F.col("cnt") == edge.cnt), near.where(F.col("cnt") != edge.cnt)
    n = near.agg(F.count_if(F.col("cnt") == edge.cnt).alias("tied"), F.count_if(F.col("cnt") != edge.cnt).alias("others")).first()
    h1, h2 = _hashes(F.col("value"))
    rows = _values(df, [columns[edge.vi]]).where(F.substring("value", 1, PREFIX) == edge.pre).select("value", h1.alias("h1"), h2.alias("h2"))
    if n.others <= min(n.tied, BROADCAST_HASHES):
        rows = rows.join(F.broadcast(others.select("h1", "h2")), ["h1", "h2"], "left_anti")
    else:
        tied = tied.select("h1", "h2")
        rows = rows.join(F.broadcast(tied) if n.tied <= BROADCAST_HASHES else tied, ["h1", "h2"], "left_semi")
    smallest = rows.select("value", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("value")).alias("at")).where(F.col("at") <= slots)
    return sorted(r.value for r in smallest.select("value").distinct().collect())


def frequency_summary(df: DataFrame, columns: list[str], k: int) -> tuple[dict, dict, dict]:
    """({column: [(value, count), ...]}, {column: distinct values}, {column: non-null values}): the ``k`` most frequent, ties by value."""
    tops, distinct, valid = {c: [] for c in columns}, dict.fromkeys(columns, 0), dict.fromkeys(columns, 0)
    if not columns:
        return tops, distinct, valid
    with Scratch() as tables:
        counts = tables.keep(hashed_counts(df, columns))
        for r in counts.groupBy("vi").agg(F.count(F.lit(1)).alias("distinct"), F.sum("cnt").alias("valid")).collect():
            distinct[columns[r.vi]], valid[columns[r.vi]] = r.distinct, r.valid
        best = sorted(_winners(counts, k).collect(), key=lambda r: (r.vi, r.pos))
        texts = _fetched(df, columns, [r for r in best if len(r.pre) >= PREFIX])
        for i, c in enumerate(columns):
            mine = [r for r in best if r.vi == i]
            if not mine:
                continue
            edge = mine[-1]
            sure = [r for r in mine if (r.cnt, r.pre) != (edge.cnt, edge.pre) or len(r.pre) < PREFIX]
            rest = len(mine) - len(sure)
            found = [(texts.get((r.vi, r.h1, r.h2), r.pre), int(r.cnt)) for r in sure]
            if rest:
                # All values of the column are among the best, or the last places go to the smallest of those that tie.
                last = [texts[r.vi, r.h1, r.h2] for r in mine if r not in sure] if distinct[c] == len(mine) else _undecided(df, columns, counts, edge, rest)
                found += [(text, int(edge.cnt)) for text in last]
            # Code points sort as UTF-8 bytes do.
            tops[c] = sorted(found, key=lambda t: (-t[1], t[0]))
    return tops, distinct, valid


def top_k_frame(df: DataFrame, columns: list[str], k: int, ascending: bool = False) -> DataFrame:
    """(variable, position, value, count, percent) for the k most frequent values.

    ``percent`` is the share of non-null rows, 1 dp.  ``ascending`` numbers the k rows from the least frequent (chart order, A17).
    """
    tops, _, valid = frequency_summary(df, columns, k)
    rows = [(c, place, value, count, valid[c]) for c in columns
            for place, (value, count) in enumerate(reversed(tops[c]) if ascending else tops[c], start=1)]
    frame = df.sparkSession.createDataFrame(rows, "variable string, position int, value string, count long, valid long")
    return frame.select("variable", "position", "value", "count", F.round(F.col("count") / F.col("valid") * 100, 1).alias("percent"))
