"""Queries of sources and sinks: tables that go through a file or the profile store and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.plans import tables as tb
from colscope.operators.profile import profile
from colscope.plans.registry import ORACLE, register
from colscope.session import Scratch
from colscope.sources.readers import read_csv
from colscope.sources.store import load_profile, profile_tables, save_profile


@register("csv_round_trip_orders", """SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority || ', said "rush"' WHEN 1 THEN 'first line,' || chr(10) || '"second" of ' || o_orderkey::VARCHAR
    WHEN 2 THEN '"' || o_orderpriority || '"' WHEN 3 THEN NULL WHEN 4 THEN chr(10) || chr(10) || ',' ELSE o_orderpriority END AS note
FROM orders""")
def q_csv_round_trip_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All orders written as CSV, with separators, quotes and line breaks inside a field, and read again by split."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    note = (F.when(key % 6 == 0, F.concat(priority, F.lit(', said "rush"')))
            .when(key % 6 == 1, F.concat(F.lit('first line,\n"second" of '), key.cast("string")))
            .when(key % 6 == 2, F.concat(F.lit('"'), priority, F.lit('"')))
            .when(key % 6 == 3, F.lit("N/A")).when(key % 6 == 4, F.lit("\n\n,")).otherwise(priority))
    status = F.when(F.col("o_orderstatus") == "P", F.lit("NULL")).otherwise(F.col("o_orderstatus"))
    rows = tb.load(spark, sf, "orders").select("o_orderkey", "o_custkey", status.alias("o_orderstatus"), "o_totalprice",
                                               F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), note.alias("note"))
    with Scratch() as files:
        path = files.path(spark)
        rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return read_csv(spark, path)


@register("store_round_trip", ORACLE["profile_variables"])
def q_store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The variable table of lineitem's profile, saved over an older profile and read from the store."""
    with Scratch() as files:
        store = files.path(spark)
        save_profile(profile_tables(profile(tb.load(spark, sf, "region"))), store, 7)
        save_profile(profile_tables(profile(tb.ln(spark, sf))), store, 7)
        return files.result(load_profile(spark, store, 7)["variables"])
