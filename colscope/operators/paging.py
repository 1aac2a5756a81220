"""Paged viewing of a table.

An index is made once: the sort keys alone are ranked by the distributed running counts, and every ``STEP``-th position is
stored with its key.  A page looks up the two marks around it, counts the keys between them (the bounds of the first key reach the
scan, no other column is read), and reads in full only the rows from the page's first key to its last.  A hash of all
columns parts rows with equal keys; it is computed for these rows only.  No task sorts the table, no wide row is shuffled, and a
second page ranks nothing.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.scalar import col, json_safe
from colscope.operators.ranks import running_before
from colscope.session import Scratch

DEFAULT_SIZE = 25
MAX_SIZE = 200
#: Rows from one stored mark to the next.
STEP = 1_000
#: Rows with the page's keys that are sorted at once; beyond it their hashes are ranked.
MOST_TIES = 100_000


class PagingError(ValueError):
    pass


def page_bounds(total_rows: int, page: int, size: int) -> dict:
    if not 1 <= size <= MAX_SIZE:
        raise PagingError(f"number_of_records debe estar entre 1 y {MAX_SIZE}")
    total_pages = max(1, (total_rows + size - 1) // size)
    current = min(max(page, 1), total_pages)
    return {
        "total_rows": total_rows, "current_page": current, "number_of_records": size,
        "total_pages": total_pages, "has_previous_page": current > 1, "has_next_page": current < total_pages,
    }


class PageIndex:
    """Positions of every ``STEP``-th row of ``df`` in the order of ``order_by`` (NULL first), for any number of pages.

    The stored marks stay in the shared checkpoint folder until ``drop`` or the end of the driver.
    """

    def __init__(self, df: DataFrame, order_by: list[str]) -> None:
        self.df, self.order_by = df, list(order_by)
        self.kind = {f.name: f.dataType for f in df.schema.fields}
        self._tables = Scratch()
        with Scratch() as tables:
            counted = df.select(self._key().alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
            placed = tables.keep(running_before(counted, [], "_key", "_n", out="_pos", tables=tables))
            self.total = placed.agg(F.sum("_n")).first()[0] or 0
            self.marks = self._tables.keep(placed.where(F.ceil(F.col("_pos") / STEP) * STEP < F.col("_pos") + F.col("_n")))

    def _key(self) -> Column:
        return F.struct(*(col(k).alias(f"k{i}") for i, k in enumerate(self.order_by)))

    def _between(self, first, last) -> Column:
        """Rows whose key lies between two keys (None: no bound on that side)."""
        inside = F.lit(True)
        for end, at_least in ((first, True), (last, False)):
            if end is None:
                continue
            bound = F.struct(*(F.lit(end[f"k{i}"]).cast(self.kind[k]).alias(f"k{i}") for i, k in enumerate(self.order_by)))
            inside = inside & ((self._key() >= bound) if at_least else (self._key() <= bound))
            if end["k0"] is not None and not (isinstance(end["k0"], float) and math.isnan(end["k0"])):
                # A plain bound that the scan can use; NULLs come first, so only an upper bound leaves them in.
                plain, edge = col(self.order_by[0]), F.lit(end["k0"]).cast(self.kind[self.order_by[0]])
                inside = inside & ((plain >= edge) if at_least else (plain.isNull() | (plain <= edge)))
        return inside

    def rows(self, start: int, size: int) -> DataFrame:
        """The rows at positions ``start`` to ``start + size - 1``, in order."""
        marks = self.marks.agg(F.max_by(F.struct("_key", "_pos"), F.when(F.col("_pos") <= start, F.col("_pos"))).alias("low"),
                               F.min_by("_key", F.when(F.col("_pos") >= start + size, F.col("_pos"))).alias("high")).first()
        if marks["low"] is None:
            return self.df.limit(0)
        # Fewer than 2 * STEP keys lie between two marks around a page of at most MAX_SIZE rows.
        near = self.df.where(self._between(marks["low"]["_key"], marks["high"])).select(self._key().alias("_key"))
        found = near.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).orderBy("_key").collect()
        at, inside, before = marks["low"]["_pos"], [], None
        for r in found:
            if at < start + size and at + r["_n"] > start:
                before = at if before is None else before
                inside.append(r)
            at += r["_n"]
        if not inside:
            return self.df.limit(0)
        held = self.df.where(self._between(inside[0]["_key"], inside[-1]["_key"])).select("*", self._key().alias("_key"), F.xxhash64(*(col(c) for c in self.df.columns)).alias("_hash"))
        skip = start - before
        if sum(r["_n"] for r in inside) > MOST_TIES:
            # Countless rows share the page's keys: their hashes are ranked, too, and only the page's rows stay.
            with Scratch() as tables:
                counted = held.select(F.struct("_key", "_hash").alias("_order")).groupBy("_order").agg(F.count(F.lit(1)).alias("_n"))
                placed = tables.keep(running_before(counted, [], "_order", "_n", out="_pos", tables=tables))
                ends = placed.where((F.col("_pos") < skip + size) & (F.col("_pos") + F.col("_n") > skip)).agg(
                    F.min(F.struct("_order", "_pos")).alias("first"), F.max("_order").alias("last")).first()
            first, last = ends["first"]["_order"], ends["last"]
            held = (held.where(self._between(first["_key"], last["_key"]))
                    .where(~(self._same(first["_key"]) & (F.col("_hash") < first["_hash"])) & ~(self._same(last["_key"]) & (F.col("_hash") > last["_hash"]))))
            skip -= ends["first"]["_pos"]
        return held.orderBy("_key", "_hash").offset(skip).limit(size).select(*(col(c) for c in self.df.columns))

    def _same(self, key) -> Column:
        out = F.lit(True)
        for i, k in enumerate(self.order_by):
            out = out & col(k).eqNullSafe(F.lit(key[f"k{i}"]).cast(self.kind[k]))
        return out

    def drop(self) -> None:
        self._tables.drop()


def page_rows(df: DataFrame, order_by: list[str], page: int = 1, size: int = DEFAULT_SIZE,
              current_page: int | None = None, index: PageIndex | None = None) -> tuple[DataFrame, dict]:
    """(rows of the page as JSON-safe values, navigation metadata).

    ``current_page`` overrides ``page``; the page is clamped to 1..total_pages.  Rows with equal ``order_by`` values follow a hash
    of all their columns, so pages never overlap.  ``index``: an index of ``df`` made before; else one is made for this page.
    """
    used = index or PageIndex(df, order_by)
    meta = page_bounds(used.total, current_page or page, size)
    meta["total_columns"] = len(df.columns)
    meta["columns"] = list(df.columns)
    rows = used.rows((meta["current_page"] - 1) * size, size)
    if index is None:
        used.drop()  # the page's rows do not read it
    return rows.select(*(json_safe(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields)), meta


def dataset_page(dataset: dict, df: DataFrame, order_by: list[str], page: int = 1, size: int = DEFAULT_SIZE,
                 index: PageIndex | None = None) -> tuple[DataFrame, dict]:
    """A page of a registered dataset: its rows, and the navigation metadata with id, name, description, file name and format."""
    rows, meta = page_rows(df, order_by, page, size, index=index)
    shown = dataset.get("file_name") or os.path.basename(dataset["path"])
    named = {"id": dataset["id"], "name": dataset.get("name"), "description": dataset.get("description"), "file_name": shown,
             "format": os.path.splitext(shown)[1].lstrip(".").upper()}
    return rows, {**named, **meta}
