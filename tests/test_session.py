"""Intermediate tables are deleted when their results are consumed."""

import os

from pyspark.sql import functions as F

from colscope import session


def _tables(spark):
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("colscope-")}


def test_scratch_deletes_what_it_kept(spark):
    before = _tables(spark)
    with session.Scratch() as tables:
        kept = tables.keep(spark.range(10))
        assert kept.count() == 10 and len(_tables(spark) - before) == 1
    assert _tables(spark) == before


def test_settled_leaves_the_result_alone(spark):
    before = _tables(spark)

    def build():
        first = session.reliable_checkpoint(spark.range(100))
        second = session.reliable_checkpoint(first.where(F.col("id") > 9))
        return second.agg(F.count("*").alias("n"))
    assert session.settled(build).first().n == 90
    assert len(_tables(spark) - before) == 1


def test_nothing_is_left_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(session, "_LIVE", {})
    before = _tables(spark)
    session.reliable_checkpoint(spark.range(3))
    session.drop_intermediates()
    assert not session._LIVE and _tables(spark) == before
