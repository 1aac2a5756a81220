"""Correlation analysis.

Matrix plans, all pairwise-complete like pandas ``DataFrame.corr``:

* Pearson: one pass; each task reduces its Arrow batches to k x k co-moment
  matrices (matrix products with null masks), the k(k+1)/2 rows per task are
  merged per pair with the parallel-variance formulas in two levels; the same pass carries
  the listwise moments and the null counts.
* Spearman and Kendall tau-b: ``rank_correlation``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.scalar import as_double, col, numeric_columns
from colscope.functions.stats import pearson_pvalue_udf
from colscope.operators.rank_correlation import kendall_sums, spearman_sums

# Strategy and method names, threshold, labels and messages.
STRATEGIES = ["ignorar", "eliminar_filas", "imputar_promedio"]
METHODS = ["pearson", "spearman", "kendall"]
STRONG_THRESHOLD = 0.7
DIRECT = "Directa"
INVERSE = "Inversa"
MIN_VARIABLES_MESSAGE = (
    "No existen suficientes variables numéricas para realizar el análisis de correlación (Mínimo requerido: 2)."
)
NOTICE_TEMPLATE = (
    "Informa: Se detectaron nulos en el dataset {counts}. Los valores faltantes fueron omitidos del cálculo."
)

class CorrelationError(ValueError):
    pass


def select_numeric(df: DataFrame) -> list[str]:
    """P1 + P2: numeric columns in schema order; fewer than two is an error."""
    cols = numeric_columns(df)
    if len(cols) < 2:
        raise CorrelationError(MIN_VARIABLES_MESSAGE)
    return cols


def numeric_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    """The numeric columns as doubles, NaN as NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[as_double(col(c), types[c]).alias(c) for c in cols])


def missing_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """A2 on the selected numeric columns (one aggregate)."""
    row = numeric_frame(df, cols).agg(*[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: int(row[f"m{i}"]) for i, c in enumerate(cols)}


def apply_null_strategy(df: DataFrame, cols: list[str], strategy: str) -> DataFrame:
    """``ignorar`` (as is), ``eliminar_filas`` (listwise drop), ``imputar_promedio`` (column means)."""
    num = numeric_frame(df, cols)
    if strategy == "ignorar":
        return num
    if strategy == "eliminar_filas":
        return num.na.drop("any", subset=cols)
    if strategy == "imputar_promedio":
        means = num.agg(*[F.avg(col(c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
        fills = {c: means[f"a{i}"] for i, c in enumerate(cols) if means[f"a{i}"] is not None}
        return num.na.fill(fills) if fills else num
    raise CorrelationError(f"Estrategia de nulos desconocida: {strategy}. Opciones: {STRATEGIES}")


def _clamp(r):
    """r into [-1, 1]; null stays null (``greatest`` alone would skip the null)."""
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


#: Pairwise moments come from the rows where both columns are there, listwise ones from the rows where all are.
PAIRWISE, LISTWISE = 0, 1
_MOMENTS = ["n", "bad", "mx", "my", "m2x", "m2y", "cxy", "lox", "hix", "loy", "hiy"]
_MOMENTS_SCHEMA = "kind int, part int, i int, j int, " + ", ".join(f"{m} double" for m in _MOMENTS)
#: Groups of tasks whose moments are combined before all are.
_FIRST_LEVEL = 64


def _batch_moments(x: np.ndarray):
    """Per column pair (i, j), on the rows where both are finite: count, means,
    centred second moments, co-moment, and min/max of each side (k x k arrays);
    and the number of rows where both are present but one is infinite."""
    m = np.isfinite(x)
    mf = m.astype(np.float64)
    present = (~np.isnan(x)).astype(np.float64)
    bad = present.T @ present - mf.T @ mf
    # shift each column by a value of its own for accuracy (any constant works)
    shift = np.where(m.any(axis=0), np.nanmax(np.where(m, x, -np.inf), axis=0), 0.0)
    x0 = np.where(m, x - shift, 0.0)
    n = mf.T @ mf                               # n[i, j]
    sx = x0.T @ mf                              # sum of x_i over rows with j present
    sxx = (x0 * x0).T @ mf
    sxy = x0.T @ x0
    with np.errstate(invalid="ignore", divide="ignore"):
        mean_x = sx / n                         # of column i, on rows with j present
        m2x = sxx - sx * sx / n
        cxy = sxy - sx * sx.T / n
    k = x.shape[1]
    lo = np.full((k, k), np.inf)
    hi = np.full((k, k), -np.inf)
    for j in range(k):
        both = m & m[:, [j]]
        lo[:, j] = np.min(np.where(both, x, np.inf), axis=0)
        hi[:, j] = np.max(np.where(both, x, -np.inf), axis=0)
    return n, mean_x + shift[:, None], np.maximum(m2x, 0.0), cxy, lo, hi, bad


def _moment_rows(kind: int, part: int, x: np.ndarray) -> pd.DataFrame:
    """Moments of all pairs i <= j over the rows of one batch."""
    n, mean, m2, c, lo, hi, bad = _batch_moments(x)
    mean, m2, c = (np.where(n > 0, values, 0.0) for values in (mean, m2, c))
    i, j = np.triu_indices(x.shape[1])
    columns = (n[i, j], bad[i, j], mean[i, j], mean[j, i], m2[i, j], m2[j, i], c[i, j], lo[i, j], hi[i, j], lo[j, i], hi[j, i])
    return pd.DataFrame({"kind": np.full(len(i), kind, np.int32), "part": np.full(len(i), part, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32),
                         **dict(zip(_MOMENTS, columns))})


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    """Moments of (kind, part, i, j) groups taken together: the parallel-variance formulas for any number of sets at once."""
    keys = ["kind", "part", "i", "j"]
    n = rows["n"].to_numpy()
    weighted = rows[keys].assign(n=n, bad=rows["bad"], mx=n * rows["mx"], my=n * rows["my"]).groupby(keys, sort=False, as_index=False).sum()
    total = np.maximum(weighted["n"].to_numpy(), 1.0)
    weighted["mx"], weighted["my"] = weighted["mx"] / total, weighted["my"] / total
    own = rows[keys].merge(weighted[[*keys, "mx", "my"]], on=keys)
    dx, dy = rows["mx"].to_numpy() - own["mx"].to_numpy(), rows["my"].to_numpy() - own["my"].to_numpy()
    centred = rows.assign(m2x=rows["m2x"] + n * dx * dx, m2y=rows["m2y"] + n * dy * dy, cxy=rows["cxy"] + n * dx * dy)
    rest = centred.groupby(keys, sort=False, as_index=False).agg({"m2x": "sum", "m2y": "sum", "cxy": "sum", "lox": "min", "hix": "max", "loy": "min", "hiy": "max"})
    return weighted.merge(rest, on=keys)[[*keys, *_MOMENTS]]


def _moments_of_partition(listwise: bool):
    def run(batches):
        part = TaskContext.get().partitionId()
        kept = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            sets = [_moment_rows(PAIRWISE, part, x)]
            complete = x[~np.isnan(x).any(axis=1)]
            if listwise and len(complete):
                sets.append(_moment_rows(LISTWISE, part, complete))
            kept = _combined(pd.concat([*sets, *([] if kept is None else [kept])], ignore_index=True))
        if kept is not None:
            yield kept
    return run


def moments(num: DataFrame, cols: list[str], listwise: bool = False) -> DataFrame:
    """(kind, i, j, n, r) for i <= j from one scan; r null for a constant side, an infinite value or < 2 rows.

    Each task turns its Arrow batches into k x k co-moment matrices with a few matrix products (null masks included) and
    puts out one set of k(k+1)/2 rows; the sets are combined in 64 groups of tasks, then to one.  No per-row explode, no
    per-row Python, no window.
    """
    parts = num.select(*[col(c) for c in cols]).mapInPandas(_moments_of_partition(listwise), _MOMENTS_SCHEMA)
    for level in (F.pmod("part", F.lit(_FIRST_LEVEL)), F.lit(0)):
        parts = parts.withColumn("part", level.cast("int")).groupBy("part").applyInPandas(_combined, _MOMENTS_SCHEMA)
    spread = (F.col("bad") == 0) & (F.col("hix") > F.col("lox")) & (F.col("hiy") > F.col("loy")) & (F.col("m2x") > 0) & (F.col("m2y") > 0)
    r = F.when(spread, F.col("cxy") / F.sqrt(F.col("m2x") * F.col("m2y")))
    seen = (F.col("n") + F.col("bad")).cast("long")
    return parts.where(seen > 0).select("kind", "i", "j", seen.alias("n"), _clamp(r).alias("r"))


def pearson_pairs(num: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, r) for i <= j, pairwise-complete."""
    return moments(num, cols).select("i", "j", "n", "r")


def spearman_pairs(num: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, r) for i < j: Pearson of average ranks taken on each pair's complete rows, as pandas ranks them.

    A constant side gives NULL: ranks are centred on their mean (n + 1) / 2, exact in binary, so it sums to exactly 0.
    """
    missing = num.agg(*[F.count_if(col(c).isNull()) for c in cols]).first()
    sums = spearman_sums(num, cols, list(missing))
    r = F.when((F.col("saa") > 0) & (F.col("sbb") > 0), F.col("sab") / (F.sqrt("saa") * F.sqrt("sbb")))
    return sums.select("i", "j", "n", _clamp(r).alias("r"))


def kendall_pairs(num: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, r) for i < j: tau-b = (n0 - n1 - n2 + n3 - 2 d) / sqrt((n0 - n1)(n0 - n2)), d the discordant pairs."""
    sums = kendall_sums(num, cols)
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    above = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("d")
    below = (n0 - F.col("n1")) * (n0 - F.col("n2"))
    return sums.select("i", "j", "n", _clamp(F.when(below > 0, above / F.sqrt(below))).alias("r"))


def matrix_pairs(num: DataFrame, cols: list[str], method: str) -> DataFrame:
    """(i, j, n, r) for i <= j, the diagonal included (1.0, or null for a constant column)."""
    if method not in METHODS:
        raise CorrelationError(
            f"method must be either 'pearson', 'spearman', 'kendall', or a callable, '{method}' was supplied")
    if method == "pearson":
        return pearson_pairs(num, cols)
    off = spearman_pairs(num, cols) if method == "spearman" else kendall_pairs(num, cols)
    # diagonal: 1.0 unless the column has no spread (Kendall: 1.0 whenever it has a value)
    diag = num.agg(*[F.struct(F.count(col(c)).alias("n"), F.min(col(c)).alias("lo"), F.max(col(c)).alias("hi")).alias(f"d{i}")
                     for i, c in enumerate(cols)])
    diag = diag.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(i).alias("j"), F.col(f"d{i}.n").alias("n"),
                 (F.when(F.col(f"d{i}.n") > 0, F.lit(1.0)) if method == "kendall"
                  else F.when(F.col(f"d{i}.hi") > F.col(f"d{i}.lo"), F.lit(1.0))).alias("r"))
        for i in range(len(cols))
    ])).alias("d")).select("d.*")
    return off.unionByName(diag)


def _names(cols: list[str], idx: str):
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col(idx) + 1)


def heatmap_cells(pairs: DataFrame, cols: list[str], decimals: int = 4) -> DataFrame:
    """All k^2 cells (id_x, id_y, valor), mirrored from i <= j; a pair with no
    complete row is a NULL cell, as in pandas (the grid is k x k, tiny)."""
    k = len(cols)
    grid = pairs.sparkSession.createDataFrame([(i, j) for i in range(k) for j in range(i, k)], "i int, j int")
    pairs = grid.join(pairs.select(F.col("i").cast("int"), F.col("j").cast("int"), "r"), ["i", "j"], "left")
    both = pairs.select("i", "j", "r").unionByName(
        pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    return both.select(_names(cols, "j").alias("id_x"), _names(cols, "i").alias("id_y"),
                       F.round("r", decimals).alias("valor"))


def coefficient(cells: DataFrame, first: str, second: str) -> float | None:
    """The coefficient of one pair from the heat-map cells; unknown names are an error."""
    hit = cells.where((F.col("id_x") == second) & (F.col("id_y") == first)).select("valor").limit(1).collect()
    if not hit:
        raise CorrelationError(f"Las variables {first} y/o {second} no existen en la matriz calculada.")
    return hit[0][0]


def strong_pairs(pairs: DataFrame, cols: list[str], threshold: float = STRONG_THRESHOLD) -> DataFrame:
    """Each unordered pair once, |rounded r| >= threshold, strongest first (ties: column order)."""
    r4 = F.round("r", 4)
    w = Window.orderBy(F.abs(F.col("coefficient")).desc(), F.col("i"), F.col("j"))
    return (
        pairs.where((F.col("i") < F.col("j")) & (F.abs(r4) >= threshold))
        .select("i", "j", r4.alias("coefficient"))
        .withColumn("position", F.row_number().over(w).cast("int"))
        .select("position", _names(cols, "i").alias("variable_1"), _names(cols, "j").alias("variable_2"),
                "coefficient", F.when(F.col("coefficient") > 0, DIRECT).otherwise(INVERSE).alias("kind"))
    )


def key_variables(strong: DataFrame) -> DataFrame:
    """Appearances in the strong pairs; most first, ties by first appearance."""
    seen = strong.select(F.explode(F.array(
        F.struct(F.col("variable_1").alias("variable"), (F.col("position") * 2).alias("at")),
        F.struct(F.col("variable_2").alias("variable"), (F.col("position") * 2 + 1).alias("at")),
    )).alias("e")).select("e.*")
    counted = seen.groupBy("variable").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first"))
    w = Window.orderBy(F.col("count").desc(), F.col("first"))
    return counted.select("variable", "count", F.row_number().over(w).cast("int").alias("position"))


def significance(num: DataFrame, cols: list[str], decimals: int = 4, listwise: DataFrame | None = None) -> DataFrame:
    """Two-sided Pearson p-values on listwise-complete rows, all k^2 cells, diagonal 0.0.

    ``listwise``: (i, j, n, r) of the complete rows, if a scan has them already.
    """
    k = len(cols)
    if listwise is None:
        listwise = moments(num, cols, listwise=True).where(F.col("kind") == LISTWISE)
    grid = num.sparkSession.createDataFrame([(i, j) for i in range(k) for j in range(i + 1, k)], "i int, j int")
    # Pairs without a coefficient have a cell too, a NULL one.
    pairs = grid.join(listwise.select(F.col("i").cast("int"), F.col("j").cast("int"), "n", "r"), ["i", "j"], "left")
    p = pairs.select("i", "j", F.round(pearson_pvalue_udf("r", "n"), decimals).alias("p_value"))
    both = p.unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "p_value"))
    diag = num.sparkSession.range(len(cols)).select(
        F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(0.0).alias("p_value"))
    return both.unionByName(diag).select(
        _names(cols, "i").alias("id_y"), _names(cols, "j").alias("id_x"), "p_value")


def omission_notice(missing: dict[str, int], strategy: str) -> str:
    """C11: only when nulls exist and they were ignored."""
    if strategy != "ignorar" or not any(v > 0 for v in missing.values()):
        return ""
    counts = "{" + ", ".join(f"{k!r}: {v}" for k, v in missing.items()) + "}"
    return NOTICE_TEMPLATE.format(counts=counts)


def correlation_report(df: DataFrame, strategy: str = "ignorar", method: str = "pearson") -> dict:
    """Numeric selection -> strategy -> matrix, p-values and null counts from one scan -> views.

    The pair tables (k^2 rows) feed every view; the row count comes from the table's metadata where the source has it.
    """
    if strategy not in STRATEGIES:
        raise CorrelationError(f"Estrategia de nulos desconocida: {strategy}. Opciones: {STRATEGIES}")
    if method not in METHODS:
        matrix_pairs(df, [], method)
    cols = select_numeric(df)
    spark, ready = df.sparkSession, apply_null_strategy(df, cols, strategy)
    schema = "i int, j int, n long, r double"
    # One scan has the pairwise and the listwise coefficients and, as the rows where a column meets itself, the null counts.
    found = moments(ready, cols, listwise=True).collect()
    listwise = spark.createDataFrame([(f.i, f.j, f.n, f.r) for f in found if f.kind == LISTWISE], schema)
    if strategy == "ignorar":
        present = {f.i: f.n for f in found if f.kind == PAIRWISE and f.i == f.j}
        total = df.count()
        missing = {c: total - present.get(i, 0) for i, c in enumerate(cols)}
    else:
        missing = missing_counts(df, cols)
    if method == "pearson":
        pairs = spark.createDataFrame([(f.i, f.j, f.n, f.r) for f in found if f.kind == PAIRWISE], schema)
    else:
        pairs = spark.createDataFrame(matrix_pairs(ready, cols, method).collect(), schema)
    strong = strong_pairs(pairs, cols)
    return {
        "configuration": {"estrategia_nulos": strategy, "metodo": method},
        "notice": omission_notice(missing, strategy),
        "heatmap": heatmap_cells(pairs, cols),
        "strong_pairs": strong,
        "key_variables": key_variables(strong),
        "significance": significance(ready, cols, listwise=listwise),
    }
