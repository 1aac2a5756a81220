"""Prefix trie of conversations by a splitter skeleton.

A node is a distinct sequence of first turns.  Every conversation is a path of turn digests; paths are dealt into sorted shards
between splitter paths taken from a sample, so all members of a node lie next to each other.  A node lies in several
shards only if it is a prefix of a splitter: these nodes form the skeleton, the trie of the splitters, which every task gets.
A task walks its sorted paths with a stack and finishes all other nodes; of skeleton nodes it puts out partial sums, which
are combined by one reduction.  Splitters end with a conversation id, so equal paths (a conversation copied countless times) are split too.

Hot groups.  Turns get their places by running totals over sorted ranges, so a conversation may hold any share of the rows; paths
are cut into segments of ``SEGMENT`` turns.  A segment is a trie of its own below the node where it begins (known by the sum
of the digests of the segments before it); what lies below a trie's last nodes comes from the tries that begin there,
summed along the conversations that own them.

Defined results: a turn with a NULL conversation id belongs to no conversation; NULL turns come first; turns that share a
number are ordered by a digest of role and text, equal turns stay; NULL role and text count as empty; an empty table has no
node.  ``c - c % 20`` truncates towards zero, as SQL does.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.mixing import word_count
from colscope.llm.running import running_totals
from colscope.session import Scratch, reliable_checkpoint

#: Turns of a segment, and bytes of a turn in a path.
SEGMENT, TURN_BYTES = 64, 16
#: Aimed segments of a shard, the most shards, and sampled paths for each.
SHARD_ROWS, MOST_SHARDS, SAMPLED = 5_000, 20_000, 4
#: Places of a conversation that share a bucket of a join.
_BUCKET = 4_096
#: Characters of a chunk of conversation ids.
CHUNK = 65_536
_EMPTY = hashlib.sha256().hexdigest()


def rebuilt_turns(turns: DataFrame, borrow: Column, base: Column, tables: Scratch, key: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv, place, digest, words), (conv, turns)): the rebuilt conversations and their lengths.

    ``borrow`` and ``base`` are expressions of ``conv``: so many first turns are taken from that conversation instead of its own.
    """
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said)))
    rows = turns.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                                                          digest.alias("digest"), word_count(said[1]).alias("words"))
    placed = running_totals(rows, ["conv"], [F.col("turn"), F.col("digest")], {"before": F.lit(1)}, turns.count(), tables)
    placed = tables.keep(placed.select("conv", "before", "digest", "words"))
    lengths = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).select("conv", "own", borrow.alias("borrowed"), base.alias("base"))
    lengths = tables.keep(lengths)
    lenders = lengths.select(F.col("conv").alias("base"), F.col("own").alias("lent"))
    lengths = lengths.join(lenders, "base", "left").select(
        "conv", "own", "base", "borrowed", F.least("borrowed", F.coalesce("lent", F.lit(0))).alias("taken"))
    lengths = tables.keep(lengths.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("borrowed"), F.lit(0))))
    heads = placed.join(lengths.select("base").distinct(), F.col("conv") == F.col("base"), "left_semi").select(F.col("conv").alias("base"), "before", "digest", "words")
    # A borrowed beginning is a few turns of a conversation that at most its own family borrows from.
    most = F.coalesce(F.max("borrowed"), F.lit(0)).alias("most")
    heads = heads.where(F.col("before") < F.lit(lengths.agg(most).first().most))
    lent = lengths.where("taken > 0").join(heads, "base").where("before < taken").select("conv", (F.col("before") + 1).alias("place"), "digest", "words")
    # A conversation's shift meets its turns by buckets of places, so a long one is many keys.
    shifts = lengths.select(F.col("conv").alias("of"), "borrowed", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / _BUCKET))).alias("bucket"))
    own = placed.join(shifts, (F.col("conv") == F.col("of")) & (F.floor(F.col("before") / _BUCKET) == F.col("bucket")))
    own = own.where("before >= borrowed").select("conv", (F.col("before") - F.col("borrowed") + F.col("taken") + 1).alias("place"), "digest", "words")
    return lent.unionByName(own), lengths.select("conv", "turns")


def _segments(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, segment, turns, path, words): digests of a segment's turns in a row, and their words; one with no turn where a path ends at a cut."""
    whole = lengths.select("conv", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("turns") / SEGMENT))).alias("segment"),
                           "turns", F.lit(None).cast("struct<place:bigint,digest:binary,words:bigint>").alias("t"))
    rows = turns.select("conv", F.floor((F.col("place") - 1) / SEGMENT).alias("segment"), F.lit(None).cast("bigint").alias("turns"),
                        F.struct("place", "digest", "words").alias("t"))
    grouped = whole.unionByName(rows).groupBy("conv", "segment").agg(F.max("turns").alias("turns"), F.sort_array(F.collect_list("t")).alias("t"))
    path = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), ""))
    return grouped.select("conv", "segment", "turns", path.alias("path"), F.transform("t", lambda t: t["words"]).alias("words"))


def _rooted(segments: DataFrame, longest: int, n_rows: int, tables: Scratch) -> DataFrame:
    """Segments and ``root``, the name of the node that each begins at: the sum of 96-bit digests of the segments before it."""
    if longest < SEGMENT:
        return segments.withColumn("root", F.lit(""))
    mark = F.md5(F.concat(F.col("segment").cast("string"), F.lit(":"), F.hex("path")))
    half = [F.conv(F.substring(mark, at, 12), 16, 10).cast("decimal(38,0)") for at in (1, 13)]
    rows = running_totals(segments.withColumn("mark", half[0] * (1 << 48) + half[1]), ["conv"], [F.col("segment")], {"sum": F.col("mark")}, n_rows, tables)
    return rows.withColumn("root", F.concat(F.col("segment").cast("string"), F.lit(":"), F.col("sum").cast("decimal(38,0)").cast("string"))).drop("mark", "sum")


# ---------------------------------------------------------------- shards and their walk

def _splitters(rows: DataFrame, n_rows: int) -> list[tuple[str, bytes, int]]:
    """Sorted (root, path, conv) that part the rows about evenly; from a sample, which decides the balance alone.

    At most ``MOST_SHARDS * SAMPLED`` paths of ``SEGMENT`` turns reach the driver (80,000 of 1 KB).
    """
    floor = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(MOST_SHARDS, max(-(-n_rows // SHARD_ROWS), min(floor, -(-n_rows // 64))))
    if shards <= 1:
        return []
    share = min(1.0, 1.2 * shards * SAMPLED / n_rows)
    part = F.pmod(F.xxhash64("conv", "segment"), F.lit(1 << 20))
    sample = rows.where(part < int(share * (1 << 20))).select("root", "path", "conv").limit(2 * shards * SAMPLED).collect()
    found = sorted((r.root, bytes(r.path), r.conv) for r in sample)
    return sorted({found[i * len(found) // shards] for i in range(1, shards)}) if found else []


def _dealt(batches: Iterator[pa.RecordBatch], splitters: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("root", "path", "conv")))
        yield pa.record_batch([*batch.columns, pa.array([bisect_right(splitters, k) for k in keys], pa.int64())], [*batch.schema.names, "shard"])


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with."""
    n = min(len(a), len(b)) // TURN_BYTES
    low = 0
    while low < n and a[low * TURN_BYTES:(low + 1) * TURN_BYTES] == b[low * TURN_BYTES:(low + 1) * TURN_BYTES]:
        low += 1
    return low


class _Node:
    """An open node of the walk, and the sums over its members and its subtree as far as they are known."""
    __slots__ = ("words", "split", "convs", "low", "children", "leaves", "saved", "below", "ends", "chunk", "size", "finished")

    def __init__(self, words: int, split: bool) -> None:
        self.words, self.split = words, split
        self.convs = self.children = self.leaves = self.saved = self.size = 0
        self.low, self.below, self.ends = None, (0, 0, 0), None
        self.chunk: list[str] = []
        self.finished: list[list] = []


_COLUMNS = {"kind": "string", "node": "binary", "parent": "binary", "segment": "bigint", "depth": "bigint", "low": "bigint", "parent_low": "bigint",
            "convs": "bigint", "children": "bigint", "leaves": "bigint", "saved": "bigint", "words": "bigint", "below_children": "bigint",
            "below_leaves": "bigint", "below_saved": "bigint", "ends": "string", "line": "array<binary>", "root": "string"}
_SCHEMA = ", ".join(f"{n} {t}" for n, t in _COLUMNS.items())
_ARROW = pa.schema([(n, {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "array<binary>": pa.list_(pa.binary())}[t]) for n, t in _COLUMNS.items()])


class _Walk:
    """Walks the sorted paths of one shard after another; ``rows`` collects what is finished."""

    def __init__(self, splitters: list, length: int, chunk: int) -> None:
        self.splitters, self.length, self.chunk, self.rows = splitters, length, chunk, []
        self.here, self.segment, self.path, self.stack, self.beside = None, 0, b"", [], []

    def add(self, shard: int, root: str, segment: int, path: bytes, words: list[int], conv: int, ends: bool, below: tuple | None) -> None:
        if (shard, root) != self.here:
            self.close()
            self.here, self.segment = (shard, root), segment
            beside = [self.splitters[k] for k in (shard - 1, shard) if 0 <= k < len(self.splitters)]
            self.beside = [p for r, p, _ in beside if r == root]
            self.stack, self.path = [_Node(0, bool(self.beside))], b""
        shared = _common(self.path, path)
        while len(self.stack) > shared + 1:
            self.pop()
        split = max((_common(p, path) for p in self.beside), default=-1)
        for k in range(shared, len(path) // TURN_BYTES):
            self.stack.append(_Node(words[k], k + 1 <= split))
        self.path = path
        node = self.stack[-1]
        node.convs += 1
        node.low = conv if node.low is None else min(node.low, conv)
        if below is not None:
            node.below = below
        if ends:
            text = str(conv)
            node.chunk.append(text)
            node.size += len(text)
            if node.size >= self.chunk:
                self.flush(node)

    def key(self, depth: int) -> bytes:
        return hashlib.md5(f"{self.here[1]}/{depth}/".encode() + self.path[:depth * TURN_BYTES]).digest()

    def flush(self, node: _Node) -> None:
        """Ids in ascending order: hashed as they come, or put out in chunks if other shards have more of them."""
        text = ",".join(node.chunk)
        if node.split:
            self.row(kind="ends", node=self.key(len(self.stack) - 1), low=int(node.chunk[0]), ends=text)
        elif node.ends is None:
            node.ends = hashlib.sha256(text.encode())
        else:
            node.ends.update(b"," + text.encode())
        node.chunk, node.size = [], 0

    def row(self, **values) -> None:
        self.rows.append([values.get(n) for n in _COLUMNS])

    def pop(self) -> None:
        depth, node = len(self.stack) - 1, self.stack[-1]
        if node.chunk:
            self.flush(node)
        self.stack.pop()
        above = self.stack[-1] if self.stack else None
        place = {"segment": self.segment, "depth": self.segment * self.length + depth, "root": self.here[1]}
        if node.split:
            gained = node.saved + node.convs * node.words
            self.row(kind="part", node=self.key(depth), parent=self.key(depth - 1) if depth else None, low=node.low, convs=node.convs, children=node.children,
                     leaves=node.leaves, saved=gained, words=node.words, below_children=node.below[0], below_leaves=node.below[1],
                     below_saved=node.below[2], line=[self.key(k) for k in range(depth + 1)], **place)
            leaves = node.leaves
        else:
            children = node.children + node.below[0]
            leaves = (node.leaves + node.below[1]) if children else 1
            gained = node.saved + node.below[2] + (node.convs - 1) * node.words
            done = dict(kind="node", low=node.low, convs=node.convs, children=children, leaves=leaves, saved=gained,
                        ends=node.ends.hexdigest() if node.ends else _EMPTY, **place)
            for child in node.finished:
                child["parent_low"] = node.low
                self.row(**child)
            if above is None:
                self.row(**done)
            elif above.split:
                self.row(parent=self.key(depth - 1), **done)
            else:
                above.finished.append(done)
            if above is not None:
                above.children += 1
        if above is not None:
            above.convs += node.convs
            above.low = node.low if above.low is None else min(above.low, node.low)
            above.leaves += leaves
            above.saved += gained

    def close(self) -> None:
        while self.stack:
            self.pop()


def _walked(batches: Iterator[pa.RecordBatch], splitters: list, length: int, chunk: int) -> Iterator[pa.RecordBatch]:
    walk = _Walk(splitters, length, chunk)

    def put_out() -> pa.RecordBatch:
        columns = zip(*walk.rows)
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
        walk.rows = []
        return out

    for batch in batches:
        names = ("shard", "root", "segment", "path", "words", "conv", "turns", "below_children", "below_leaves", "below_saved")
        for shard, root, segment, path, words, conv, turns, *below in zip(*(batch.column(n).to_pylist() for n in names)):
            ends = turns <= (segment + 1) * length and (segment == 0 or turns > segment * length)
            walk.add(shard, root, segment, path, words, conv, ends, None if below[0] is None else tuple(below))
            if len(walk.rows) >= 10_000:
                yield put_out()
    walk.close()
    if walk.rows:
        yield put_out()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of its sorted chunks of ids, joined by commas."""
    name, digest = None, None
    for batch in batches:
        done = []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if node != name:
                if digest:
                    done.append((name, digest.hexdigest()))
                name, digest = node, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["node", "ends"])
    if digest:
        yield pa.record_batch([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends"])


# ---------------------------------------------------------------- the tries

def _tries(rows: DataFrame, tables: Scratch) -> DataFrame:
    """All nodes of the tries of ``rows``: segment, depth, root, low, parent_low, convs, children, leaves, saved, ends."""
    spark = rows.sparkSession
    splitters = _splitters(rows, rows.count())
    shared = spark.sparkContext.broadcast(splitters)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.mapInArrow(lambda it: _dealt(it, shared.value), f"{kind}, shard bigint")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "root", "path", "conv")
    length, chunk = SEGMENT, CHUNK
    out = tables.keep(dealt.mapInArrow(lambda it: _walked(it, shared.value, length, chunk), _SCHEMA))
    named = ["segment", "depth", "root", "low", "parent_low", "convs", "children", "leaves", "saved", "ends"]
    finished = out.where("kind = 'node' AND parent IS NULL").select(*named)
    if not splitters:
        return finished
    parts = out.where("kind = 'part'").groupBy("node").agg(
        *(F.first(c).alias(c) for c in ("parent", "segment", "depth", "root", "words", "line")), F.min("low").alias("low"),
        *(F.sum(c).alias(c) for c in ("convs", "children", "leaves", "saved")), *(F.max(f"below_{c}").alias(f"below_{c}") for c in ("children", "leaves", "saved")))
    parts = tables.keep(parts)
    kin = parts.groupBy("parent").agg(F.count(F.lit(1)).alias("kin")).select(F.col("parent").alias("node"), "kin")
    parts = parts.join(kin, "node", "left").withColumn("children", F.col("children") + F.coalesce("kin", F.lit(0)) + F.col("below_children"))
    # What a skeleton node adds itself, once, to all nodes from it up to the root.
    once = F.when(F.col("children") == 0, 1).otherwise(0) + F.col("below_leaves")
    own = parts.select(F.explode("line").alias("node"), once.alias("leaves"), (F.col("below_saved") - F.col("words")).alias("saved"))
    own = own.groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    chunks = out.where("kind = 'ends'").select("node", "low", "ends").repartition("node").sortWithinPartitions("node", "low")
    ended = chunks.mapInArrow(_chained, "node binary, ends string")
    skeleton = parts.join(own, "node").join(ended, "node", "left").select(
        "node", "parent", "segment", "depth", "root", "low", "convs", "children", (F.col("leaves") + F.col("more_leaves")).alias("leaves"),
        (F.col("saved") + F.col("more_saved")).alias("saved"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends"))
    skeleton = tables.keep(skeleton)
    # Skeleton nodes are prefixes of splitters: at most MOST_SHARDS * (SEGMENT + 1), about 1.3 million rows of two numbers.
    names = F.broadcast(skeleton.select(F.col("node").alias("parent"), F.col("low").alias("above")))
    late = out.where("kind = 'node' AND parent IS NOT NULL").drop("parent_low").join(names, "parent").withColumnRenamed("above", "parent_low")
    return finished.unionByName(late.select(*named)).unionByName(
        skeleton.join(names, "parent", "left").withColumnRenamed("above", "parent_low").select(*named))


def _below(rows: DataFrame, n_rows: int, tables: Scratch) -> DataFrame:
    """(conv, segment, below_children, below_leaves, below_saved): the sums of all that begins at the end of that segment.

    Every trie counts once, for its smallest member.  What a conversation owns from a segment on lies below that segment's root,
    so a root's sums are those of all its members from there on.
    """
    later = tables.keep(rows.where("segment > 0"))
    # A path that goes on does not end in a leaf.
    marked = later.select("*", F.when(F.col("turns") > (F.col("segment") + 1) * SEGMENT, 1).cast("bigint").alias("below_children"),
                          F.lit(0).cast("bigint").alias("below_leaves"), F.lit(0).cast("bigint").alias("below_saved"))
    nodes = tables.keep(_tries(marked, tables).where(F.col("depth") == F.col("segment") * SEGMENT))
    tries = nodes.select("root", F.col("low").alias("conv"), "children", F.when(F.col("children") > 0, F.col("leaves")).otherwise(0).alias("leaves"), "saved")
    owned = later.select("conv", "segment", "root").join(tries.select("conv", "root", "leaves", "saved"), ["conv", "root"], "left")
    owned = owned.select("conv", "segment", "root", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    summed = tables.keep(running_totals(owned, ["conv"], [F.col("segment").desc()], {"leaves_after": F.col("leaves"), "saved_after": F.col("saved")}, n_rows, tables))
    totals = summed.groupBy("root").agg(F.sum(F.col("leaves") + F.col("leaves_after")).alias("below_leaves"),
                                        F.sum(F.col("saved") + F.col("saved_after")).alias("below_saved"), F.count(F.lit(1)).alias("members"))
    totals = totals.join(tries.select("root", F.col("children").alias("below_children")), "root")
    # A root with countless members meets them by buckets of their places.
    totals = totals.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("members") / _BUCKET))))
    placed = running_totals(summed.select("conv", "segment", "root"), ["root"], [F.col("conv")], {"at": F.lit(1)}, n_rows, tables)
    placed = placed.withColumn("bucket", F.floor(F.col("at") / _BUCKET))
    return placed.join(totals, ["root", "bucket"]).select("conv", (F.col("segment") - 1).alias("segment"), "below_children", "below_leaves", "below_saved")


def prefix_trie(turns: DataFrame, borrow: Column | None = None, base: Column | None = None, key: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``borrow`` and ``base`` (expressions of ``conv``) rebuild a conversation: its first ``borrow`` turns are those of ``base``;
    by default conversations stay as they are.
    """
    with Scratch() as tables:
        rebuilt, lengths = rebuilt_turns(turns, F.lit(0) if borrow is None else borrow, F.col("conv") if base is None else base, tables, key, turn, role, text)
        segments = tables.keep(_segments(rebuilt, lengths))
        found = segments.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("turns"), F.lit(0)).alias("longest")).first()
        rows = _rooted(segments, found.longest, found.n, tables)
        if found.longest < SEGMENT:
            rows = rows.select("*", *(F.lit(None).cast("bigint").alias(f"below_{c}") for c in ("children", "leaves", "saved")))
        else:
            rows = tables.keep(rows)
            rows = tables.keep(rows.join(_below(rows, found.n, tables), ["conv", "segment"], "left"))
        nodes = _tries(rows, tables).where((F.col("segment") == 0) | (F.col("depth") > F.col("segment") * SEGMENT))
        return reliable_checkpoint(nodes.select(
            F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("convs").alias("n_convs"),
            F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")))
