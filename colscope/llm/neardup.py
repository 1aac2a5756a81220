"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set holds its distinct shingles; its sketch is the k smallest of their hashes.
Of the union of two sets with similarity s, the k smallest hashes fall into the
intersection with probability s each, and those stand in both sketches.  So the overlap of
the sketches that a link can have at least is known (``least_overlap``, 5.5 standard
deviations below its mean: it is missed with a probability of about 1e-7 at the limit and far
less above it; sets whose union is no larger than the sketch are treated exactly).

1. One scan makes size, fingerprint and sketch of every set.  Equal sets form a class; only
   its representative goes on.
2. A document with fewer than the least overlap of values that others retain as well has no
   partner.  This is tested with short sketches first, then with longer ones.
3. Of the documents that are left, wide sketches are made (the whole set of all but long documents).  Inverted
   lists hold the values of a document rarest first, and of them only as many as any partner must hit.  A value
   of a passage that countless documents share comes last, so it only makes candidates of documents that
   consist of such passages; a copy with many words of its own has none of the values of its like.
4. In each list every member is compared with one member, its hub (the one whose values are the most
   common, then others), not with all others: the sketch of the union filters, the exact similarity of the
   full sets decides.  Components are formed, and the next round only takes lists that are still in several; rounds go on
   while they join a fair share of what is open.
5. For the rest, members of different components in one list are compared in blocks inside the tasks, each pair in the first of its lists only.  Pairs whose sketches
   are their whole sets are decided there, so a block puts out only as many of them as connect its members; pairs of longer sets
   that pass the sketch filter are verified likewise.

Defined results: texts without words have an empty set and are linked with nothing; NULL text counts as
empty; a NULL doc_id takes part, but names a component only if no member has an id; rows that repeat or share
a doc_id are rows of their own; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import release_memory, small_batches, task_number, text_chunks
from colscope.llm.components import connected_components
from colscope.llm.words import ascii_words, window_hashes, word_hashes
from colscope.session import Scratch, reliable_checkpoint, settled

#: Sketch sizes of the two tests and of the lists.
SHORT, SKETCH, WIDE = 16, 64, 512
#: Standard deviations that the overlap of a link may stay below its mean.
DEVIATIONS = 5.5
#: Rounds of hubs before the blocks, at most, and the share of open documents that a round must join for another one to follow.
HUB_ROUNDS, FAIR_SHARE = 16, 0.02
#: Pairs of one hub that are verified in one group.
HUB_PAIRS = 256
#: Members of a list that one block holds.
BLOCK = 256
#: Values that a block compares at a time.
_COLUMNS = 16_384
#: A table of (row, few numbers) is broadcast up to this many rows: under 16 MB each.
BROADCAST_ROWS = 250_000


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text with fewer words has one, of all its words."""
    hashes = word_hashes(ascii_words(text, lower=True))
    return np.unique(window_hashes(hashes, min(width, len(hashes)))) if len(hashes) else np.zeros(0, dtype=np.int64)


def least_overlap(size: int, sketch: int, similarity: float) -> int:
    """Values that a set of ``size`` must have in common with a linked set's sketch."""
    exact = int(np.ceil(round(similarity * size, 9)))
    union = size / similarity
    if union <= sketch:
        return max(1, exact)
    variance = sketch * similarity * (1 - similarity) * (union - sketch) / (union - 1)
    return max(1, min(exact, int(similarity * sketch - DEVIATIONS * variance ** 0.5)))


def _sketches(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    row = task_number() << 36
    for batch in batches:
        tags, at = batch.column(2).to_pylist(), 0
        for ids, texts in text_chunks(iter([batch])):
            out: list[list] = [[] for _ in range(8)]
            for key, text in zip(ids, texts):
                values = shingle_set(text, width)
                n = len(values)
                mark = xxhash.xxh3_128_digest(values.tobytes()) if n else None
                for column, value in zip(out, (row, key, tags[at], n, mark, values[:SKETCH].tolist(),
                                               least_overlap(n, SHORT, similarity), least_overlap(n, SKETCH, similarity))):
                    column.append(value)
                row += 1
                at += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)],
                                  ["row", "doc_id", "tag", "n_shingles", "mark", "sketch", "least_short", "least"])
    release_memory()


_SKETCH_SCHEMA = "row long, doc_id long, tag long, n_shingles long, mark binary, sketch array<long>, least_short int, least int"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _retained(postings: DataFrame) -> DataFrame:
    """(row, value, df, ...) of values that at least two documents retain."""
    counts = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    return postings.join(counts, "value")


def _members(sketched: DataFrame, tables: Scratch) -> DataFrame:
    """Rows of representatives that can have a partner by both tests."""
    leaders = sketched.where("n_shingles > 0").groupBy("mark").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first"))
    rows = tables.keep(leaders.select(F.col("first.row").alias("row")))
    for size, least in ((SHORT, "least_short"), (SKETCH, "least")):
        values = tables.keep(sketched.join(_small(rows, rows.count()), "row").select("row", F.col(least).alias("least"), F.explode(F.slice("sketch", 1, size)).alias("value")))
        rows = tables.keep(_retained(values).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).where("n >= least").select("row"))
    return rows


def _wide_sketches(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_chunks(iter([batch])):
            sets = [shingle_set(t, width) for t in texts]
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array([v[:WIDE].tolist() for v in sets], pa.list_(pa.int64())),
                                   pa.array([least_overlap(len(v), WIDE, similarity) for v in sets], pa.int32())], ["row", "sketch", "least"])
    release_memory()


def _candidate_lists(wide: DataFrame) -> DataFrame:
    """(value, row, weight): the inverted lists, without values that no partner needs to hit; weight: how common a row's values are."""
    held = (_retained(wide.select("row", "least", F.explode("sketch").alias("value"))).groupBy("row")
            .agg(F.first("least").alias("least"), F.sum("df").alias("weight"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
            .where(F.size("held") >= F.col("least")))
    wanted = held.select("row", "weight", F.explode(F.slice("held", F.lit(1), F.size("held") - F.col("least") + 1)).alias("v"))
    return wanted.select(F.col("v.value").alias("value"), "row", "weight")


def _passes(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """False if the wide sketches show that the sets are not similar: exactly if they hold the whole union, else by its sketch."""
    common = np.intersect1d(a, b, assume_unique=True)
    size = len(a) + len(b) - len(common)
    if size <= WIDE:
        return 100 * len(common) >= percent * size
    # Both sketches are cut at WIDE, so the union is larger than ``size``; the least overlap is that of an unbounded one.
    similarity = percent / 100
    least = similarity * WIDE - DEVIATIONS * (WIDE * similarity * (1 - similarity)) ** 0.5
    return int((common <= np.union1d(a, b)[WIDE - 1]).sum()) >= least


def _sketch_filter(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        keep = [_passes(a[i].values.to_numpy(), b[i].values.to_numpy(), percent) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs with 100 * |intersection| >= percent * |union|."""
    last_row, last_set = None, None
    for batch in batches:
        keep = []
        rows, hubs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            if hubs[i] != last_row:
                last_row, last_set = hubs[i], shingle_set(batch.column(3)[i].as_py(), width)
            own = shingle_set(batch.column(2)[i].as_py(), width)
            common = len(np.intersect1d(own, last_set, assume_unique=True))
            keep.append(100 * common >= percent * (len(own) + len(last_set) - common))
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(hubs, pa.int64())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    release_memory()


def _verified(pairs: DataFrame, texts: DataFrame, n_pairs: int, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; b is the side that stands in many pairs.

    A text meets its hub's in groups of about ``HUB_PAIRS`` pairs, so a hub of countless documents is many groups.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("groups"))
    dealt = pairs.join(_small(groups, n_pairs), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("group"))
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")).join(_small(dealt, n_pairs), "a")
    hubs = groups.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")).join(_small(hubs, n_pairs), "b")
    return (left.join(right, ["b", "group"]).select("a", "b", "text_a", "text_b")
            .mapInArrow(lambda it: _similar(it, width, percent), "a long, b long"))


def _open_lists(lists: DataFrame, roots: DataFrame, n_roots: int) -> DataFrame:
    """(value, row, root) of lists in several components; of lists with the same members, one."""
    named = lists.join(_small(roots, n_roots), "row")
    marks = named.groupBy("value").agg(F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(20,0)")).alias("t"),
                                       F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    one = marks.where("low < high").groupBy("s", "t", "n").agg(F.min("value").alias("value"), F.first("n").alias("members"))
    return named.join(one.select("value", "members"), "value")


def _joined(roots: DataFrame, fresh: DataFrame, n_roots: int, tables: Scratch) -> DataFrame:
    """(row, root) after the edges ``fresh``: components of components, then every row's."""
    ends = [_small(roots.select(F.col("row").alias(s), F.col("root").alias(f"root_{s}")), n_roots) for s in ("a", "b")]
    between = fresh.join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    merged = connected_components(tables.keep(between)).select(F.col("row").alias("root"), F.col("root").alias("merged"))
    return tables.keep(roots.join(_small(merged, n_roots), "root", "left").select("row", F.coalesce("merged", "root").alias("root")))


def _spanning(pairs: np.ndarray, size: int) -> list[int]:
    """Places of the pairs that connect something new when they are taken in turn."""
    lead, taken = list(range(size)), []
    for at, (a, b) in enumerate(pairs.tolist()):
        while lead[a] != a:
            lead[a] = lead[lead[a]]
            a = lead[a]
        while lead[b] != b:
            lead[b] = lead[lead[b]]
            b = lead[b]
        if a != b:
            lead[max(a, b)] = min(a, b)
            taken.append(at)
    return taken


def _numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of a list column."""
    return [part.values.to_numpy()[at:to] for part in column.chunks for at, to in pairwise(part.offsets.to_numpy())]


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common values of every set of one side with every set of the other: products of a 0/1 matrix over the values that several sets hold."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.flatnonzero(np.bincount(place, minlength=len(values)) > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    column = column[place]
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, len(shared), _COLUMNS):
        here = (column >= first) & (column < first + _COLUMNS)
        marks = np.zeros((len(sets), min(_COLUMNS, len(shared) - first)), dtype=np.float32)
        marks[owner[here], column[here] - first] = 1
        overlap += marks[left] @ marks[right].T
    return overlap


def _across(block: pa.Table, percent: int) -> pa.Table:
    """Pairs of a block's two sides that connect its components, and pairs of long sets between components that pass the sketch filter.

    Pairs that stand together in an earlier list (column ``earlier``, if there) are left to it.
    """
    side = block.column("side").to_numpy()
    rows, roots = (block.column(c).to_numpy() for c in ("row", "root"))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    apart = roots[left][:, None] != roots[right][None, :]
    if (side == 2).any():  # both sides are the same block: each pair once
        apart &= rows[left][:, None] < rows[right][None, :]
    if "earlier" in block.column_names and apart.any():
        apart &= _overlaps(_numbers(block.column("earlier")), left, right) == 0
    # Most lists hold next to no pair that is new.
    some, other = apart.any(axis=1), apart.any(axis=0)
    left, right, apart = left[some], right[other], apart[some][:, other]
    found: list[tuple[int, int]] = []
    if len(left):
        sketches = _numbers(block.column("sketch"))
        used = np.unique(np.r_[left, right])
        overlap = _overlaps([sketches[x] for x in used], np.searchsorted(used, left), np.searchsorted(used, right))
        sizes = np.array([len(s) for s in sketches], dtype=np.float32)
        union = sizes[left][:, None] + sizes[right][None, :] - overlap
        short = sizes < WIDE
        whole = short[left][:, None] & short[right][None, :]
        # Whole sets decide a pair, so edges between components that are connected already are not needed.
        sure = np.argwhere(apart & whole & (100 * overlap >= percent * union))
        part = np.unique(roots, return_inverse=True)[1]
        edges = np.stack([part[left[sure[:, 0]]], part[right[sure[:, 1]]]], axis=1)
        found = [(left[sure[at, 0]], right[sure[at, 1]]) for at in _spanning(edges, len(rows))]
        likely = np.argwhere(apart & ~whole & ((100 * overlap >= percent * union) | (union > WIDE)))
        found += [(left[x], right[y]) for x, y in likely.tolist() if _passes(sketches[left[x]], sketches[right[y]], percent)]
    found = [(int(rows[x]), int(rows[y])) for x, y in found]
    a, b = ([max(p) for p in found], [min(p) for p in found])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _block_pairs(opened: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """(a, b) across components, found block by block: a block of a list meets every block of it once.

    Near copies share many lists, so a pair is compared in the first of its lists only.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("long")
    placed = opened.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("row", F.lit(7)), F.col("blocks")))
    met = placed.select("value", "row", "root", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    met = met.select("value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row", "root", side.alias("side"))
    # No more lists than values of a wide sketch.
    held = opened.groupBy("row").agg(F.sort_array(F.collect_list("value")).alias("lists"))
    earlier = F.filter("lists", lambda v: v < F.col("value")).alias("earlier")
    full = met.join(held, "row").select(*met.columns, earlier).join(wide.select("row", "sketch"), "row")
    return full.groupBy("value", "i", "j").applyInArrow(lambda block: _across(block, percent), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, tag (hash of the text), n_shingles, component_id, leader (one row per component)."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tag"))
    similarity = percent / 100
    with Scratch() as tables:
        sketched = tables.keep(rows.mapInArrow(lambda it: _sketches(it, width, similarity), _SKETCH_SCHEMA))
        members = _members(sketched, tables)
        n_members = members.count()
        known = tables.keep(sketched.join(_small(members, n_members), "row").select("row", F.col("doc_id").alias("id"), F.col("tag").alias("mark")))
        # The texts of candidates, by id and hash of the text; equal texts under one id are one text.
        found = rows.join(_small(known, n_members), rows["doc_id"].eqNullSafe(F.col("id")) & (rows["tag"] == F.col("mark"))).select("row", "text")
        texts = tables.keep(found.dropDuplicates(["row"]) if _repeats(sketched) else found)
        known = tables.keep(texts.mapInArrow(lambda it: _wide_sketches(it, width, similarity), "row long, sketch array<long>, least int"))
        lists = tables.keep(_candidate_lists(known))
        roots = tables.keep(known.select("row", F.col("row").alias("root")))
        n_roots, turn = roots.count(), 0
        while True:
            opened = tables.keep(_open_lists(lists, roots, n_roots))
            n_open = opened.select("row").distinct().count()
            if not n_open:
                break
            hubs_go_on = turn < HUB_ROUNDS
            if hubs_go_on:
                order = F.struct(-F.col("weight") if turn == 0 else F.xxhash64("row", F.lit(turn)), F.col("row"), F.col("root"))
                hubs = opened.groupBy("value").agg(F.min(order).alias("hub")).select("value", F.col("hub.row").alias("b"), F.col("hub.root").alias("hub_root"))
                pairs = opened.join(hubs, "value").where(F.col("root") != F.col("hub_root")).select(F.col("row").alias("a"), "b").distinct()
                sides = [known.select(F.col("row").alias(s), F.col("sketch").alias(f"sketch_{s}")) for s in ("a", "b")]
                pairs = (pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sketch_a", "sketch_b")
                         .mapInArrow(lambda it: _sketch_filter(it, percent), "a long, b long"))
            else:
                pairs = _block_pairs(opened, known, percent)
            pairs = tables.keep(pairs)
            fresh = tables.keep(_verified(pairs, texts, pairs.count(), width, percent))
            n_fresh = fresh.count()
            if n_fresh:
                roots = _joined(roots, fresh, n_roots, tables)
            if not hubs_go_on:
                break
            # The blocks follow when hubs find little more.
            turn = turn + 1 if n_fresh > FAIR_SHARE * n_open else HUB_ROUNDS
        return reliable_checkpoint(_named(sketched, roots))


def _repeats(sketched: DataFrame) -> bool:
    """True if rows share id and text."""
    return not sketched.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _named(sketched: DataFrame, roots: DataFrame) -> DataFrame:
    """Components of representatives, spread to all members of their classes."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    slim = sketched.select("row", "doc_id", "tag", "n_shingles", F.coalesce("mark", F.encode(F.col("row").cast("string"), "utf-8")).alias("mark"))
    classes = slim.groupBy("mark").agg(first.alias("first"))
    joined = (classes.select("mark", "first", F.col("first.row").alias("row")).join(roots, "row", "left")
              .select("mark", F.coalesce("root", "row").alias("root"), "first"))
    names = joined.groupBy("root").agg(F.min("first").alias("name"))
    by_class = joined.join(names, "root").select("mark", F.col("name.doc_id").alias("component_id"), F.col("name.row").alias("leading"))
    return (slim.join(by_class, "mark")
            .select("doc_id", "tag", "n_shingles", "component_id", (F.col("row") == F.col("leading")).alias("leader")))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: one row of each component stays."""
    keys = settled(lambda: near_duplicates(docs, key, text, width, percent).groupBy("doc_id", "tag").agg(
        F.max("leader").alias("stays"), F.count(F.lit(1)).alias("n")))
    gone, twice = keys.where(~F.col("stays")), keys.where("stays and n > 1")
    tag = F.xxhash64(F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.`{key}`").cast("long").alias("own_id"), tag.alias("own_tag"))

    def same(of: DataFrame):
        return rows["own_id"].eqNullSafe(of["doc_id"]) & (rows["own_tag"] == of["tag"])

    kept = rows.join(_small(gone, gone.count()), same(gone), "left_anti")
    if n_twice := twice.count():
        # Rows that share id and text: one of them stays.
        twice = _small(twice, n_twice)
        once = kept.join(twice, same(twice), "left_semi").dropDuplicates(["own_id", "own_tag"])
        kept = kept.join(twice, same(twice), "left_anti").unionByName(once)
    return kept.select("row.*")
