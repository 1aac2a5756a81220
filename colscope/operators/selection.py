"""Diverse-variable selection and chart data.

Spark ranks the variables from the profile and finds the pairs that are too similar; a k x k matrix of these is
all that the driver needs to strike out neighbours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.scalar import NUMERIC
from colscope.operators import correlation as corr
from colscope.operators import distributions as dist
from colscope.operators.frequencies import top_k_frame
from colscope.operators.profile import Profile, profile

# Charts per report and the "too similar" correlation bound.
MAX_CHARTS = 12
HIGH_CORRELATION = 0.70


def similarity_graph(df: DataFrame, names: list[str], bound: float = HIGH_CORRELATION) -> np.ndarray:
    """Boolean matrix over ``names``: True where |Pearson r| exceeds ``bound`` (a missing r is no similarity)."""
    graph = np.zeros((len(names), len(names)), dtype=bool)
    if len(names) > 1:
        close = corr.pearson_pairs(corr.numeric_frame(df, names), names).where((F.col("i") < F.col("j")) & (F.abs("r") > bound))
        for edge in close.select("i", "j").collect():
            graph[edge.i, edge.j] = graph[edge.j, edge.i] = True
    return graph


def first_independent(graph: np.ndarray) -> list[int]:
    """The independent set that takes the lowest remaining node and strikes out its neighbours, until none remains."""
    remaining, taken = np.ones(len(graph), dtype=bool), []
    while remaining.any():
        node = int(np.flatnonzero(remaining)[0])
        taken.append(node)
        remaining &= ~graph[node]
        remaining[node] = False
    return taken


def select_diverse(df: DataFrame, prof: Profile | None = None, limit: int = MAX_CHARTS) -> list[tuple[str, str]]:
    """(variable, type) in chart order.

    Variables rank by nulls and outliers together, then by valid values, then by place.  The numeric ones that are
    independent of all better ranked ones taken come first, the others follow; the first ``limit`` are charted.
    """
    table = (prof or profile(df, details=False)).variables_frame()
    trouble = F.col("nulls") + F.coalesce("outliers", F.lit(0))
    ranked = table.orderBy(trouble.desc(), F.desc("valid"), "ordinal").select("variable", "variable_type").collect()
    numeric = [r.variable for r in ranked if r.variable_type == NUMERIC]
    charted = [(numeric[k], NUMERIC) for k in first_independent(similarity_graph(df, numeric))]
    return [*charted, *((r.variable, r.variable_type) for r in ranked if r.variable_type != NUMERIC)][:limit]


def selection_frame(df: DataFrame) -> DataFrame:
    rows = [(place, *chosen) for place, chosen in enumerate(select_diverse(df), start=1)]
    return df.sparkSession.createDataFrame(rows, "position int, variable string, variable_type string")


def chart_data(df: DataFrame, variables: list[tuple[str, str]]) -> DataFrame:
    """Left-closed histogram (<= 10 bins) per numeric variable, top-8 ascending otherwise.

    Long table (variable, chart, position, label, count).
    """
    spark = df.sparkSession
    numeric = [n for n, k in variables if k == NUMERIC]
    other = [n for n, k in variables if k != NUMERIC]
    parts = []
    if numeric:
        h = dist.histogram_frame(df, numeric, right_closed=False)
        parts.append(h.select("variable", F.lit("histogram").alias("chart"), F.col("bin").alias("position"),
                              "label", "count"))
    if other:
        t = top_k_frame(df, other, 8, ascending=True)
        parts.append(t.select("variable", F.lit("bars").alias("chart"), "position",
                              F.col("value").alias("label"), "count"))
    if not parts:
        return spark.createDataFrame([], "variable string, chart string, position int, label string, count long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
