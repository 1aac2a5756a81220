"""Input tables of the registered queries and the derived views they share.

The driver tables hold no nulls, so null handling is exercised on derived
views that are built the same way here (DataFrame API) and in the SQL oracle
(``*_SQL`` strings below):

* ``ln``  lineitem with ``l_quantity`` null on line 7, ``l_discount`` null on
  line 6 and ``l_returnflag`` null where it is 'N' on line 5;
* ``lnc`` ``ln`` plus three derived columns that are strongly correlated with
  existing ones, so strong pairs exist;
* ``dl``  documents LEFT JOIN labels (unlabelled documents get null labels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ln(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(line == 7, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(line == 6, None).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when((F.col("l_returnflag") == "N") & (line == 5), None)
        .otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate",
    )


LN_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount END AS l_discount,
  l_tax,
  CASE WHEN l_returnflag = 'N' AND l_linenumber = 5 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate
FROM lineitem"""

LN_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LN_NUMERIC = LN_COLUMNS[:8]


def lnc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ln(spark, sf_dir)
    return base.select(
        *LN_NUMERIC,
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("l_qty_tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_net"),
        (F.lit(100.0) - F.col("l_quantity")).alias("l_qty_left"),
    )


def lnc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ln`` (every column) plus the three derived numeric columns of ``lnc``."""
    return ln(spark, sf_dir).select(
        "*",
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("l_qty_tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_net"),
        (F.lit(100.0) - F.col("l_quantity")).alias("l_qty_left"),
    )


LNC_SQL = f"""SELECT {', '.join(LN_NUMERIC)},
  l_quantity * 2 + l_tax AS l_qty_tax,
  l_extendedprice * (1 - l_discount) AS l_net,
  100.0 - l_quantity AS l_qty_left
FROM ({LN_SQL}) b"""

LNC_NUMERIC = LN_NUMERIC + ["l_qty_tax", "l_net", "l_qty_left"]


def dl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


DL_SQL = """SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

DL_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def orders_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with the order date held as text (exercises date sniffing, F2)."""
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                    F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority")


ORDERS_TEXT_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"""
