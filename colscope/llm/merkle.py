"""Merkle manifest of a dataset, in native expressions: levels as hex strings in aligned blocks.

Leaves are digests of whole rows.  Inside a language they ascend by id; every 8 neighbouring nodes become the
digest of their hex texts, until one node is left (the subroot), and the subroots in the order of languages
likewise become the root.

A block holds 512 aligned leaves (three levels) as one string of 64 hex digits each.  Fixed-width substrings of
512 digits are the runs, whose digests joined are the next level's string; the digits beside a node's own in
its run are its siblings.  The tops of a language's blocks are leaves of the next round of blocks, so a language of n documents
takes log512(n) rounds, and on the way down every block hands its own path to its members.  A task never holds
more than a block: positions come from running totals over sorted ranges, whatever share of the rows a language has.
Texts are hashed where they are read and never shuffled.

Defined results: NULL fields are written ``-``; a NULL language is one of its own, the first; NULL ids come first in it;
rows that share an id are ordered by their digests, equal rows are leaves of their own; a row without an id is never
tampered with; an empty table gives an empty manifest.  Extra columns are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.running import running_totals
from colscope.session import Scratch, reliable_checkpoint

#: Nodes of a run, hex digits of a digest, and the letters that tampering changes.
RUN, DIGEST = 8, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels inside a block, and so its leaves.
LEVELS = 3
BLOCK = RUN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: every field as its UTF-8 length, a colon and itself; NULL is a dash."""
    texts = [c.cast("string") for c in columns]
    return _digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _substrings(level: Column) -> Column:
    """The runs of a level: substrings of 8 digests, the last one may be shorter."""
    width = RUN * DIGEST
    last = F.ceil(F.length(level) / width).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda r: F.substring(level, r * width + 1, F.lit(width)))


def _joined_digests(runs: Column) -> Column:
    return F.array_join(F.transform(runs, _digest), "")


def _levelled(blocks: DataFrame) -> DataFrame:
    """Blocks (group, block, alone, members) with ``runs`` of the levels that their nodes go through, and ``top``."""
    level = F.array_join(F.transform("members", lambda m: m["node"]), "")
    n = F.size("members")
    # A block beside others always climbs three levels; one alone stops when a single node is left.
    depth = F.when(~F.col("alone"), LEVELS).when(n == 1, 0).when(n <= RUN, 1).when(n <= RUN * RUN, 2).otherwise(3)
    rows = blocks.select("*", depth.alias("depth"), level.alias("level0"))
    for k in range(LEVELS):
        rows = rows.select("*", _substrings(F.col(f"level{k}")).alias(f"runs{k}"))
        rows = rows.select("*", _joined_digests(F.col(f"runs{k}")).alias(f"level{k + 1}"))
    top = F.element_at(F.array(*(F.col(f"level{k}") for k in range(LEVELS + 1))), F.col("depth") + 1)
    runs = F.slice(F.array(*(F.col(f"runs{k}") for k in range(LEVELS))), F.lit(1), F.col("depth"))
    return rows.select("group", "block", "alone", "members", runs.alias("runs"), top.alias("top"))


def _siblings(runs: Column, at: Column) -> Column:
    """Digits on the left and on the right of member ``at`` (from 0) in its run, level by level."""
    def segment(level: Column, k: Column) -> Column:
        node = F.floor(at / F.pow(F.lit(float(RUN)), k)).cast("int")
        run, place = F.element_at(level, F.floor(node / RUN).cast("int") + 1), node % RUN
        return F.struct(F.substring(run, F.lit(1), place * DIGEST).alias("left"), F.substring(run, place * DIGEST + DIGEST + 1, F.lit(RUN * DIGEST)).alias("right"))
    return F.transform(runs, segment)


def _blocks(nodes: DataFrame, tables: Scratch) -> DataFrame:
    """Nodes (group, pos, node, load) in blocks; ``alone``: the group's only one."""
    members = F.sort_array(F.collect_list(F.struct("pos", "node", "load")))
    blocks = tables.keep(nodes.groupBy("group", F.floor(F.col("pos") / BLOCK).alias("block")).agg(members.alias("members")))
    more = blocks.where("block = 1").select(F.col("group").alias("_group"), F.lit(True).alias("_more"))
    first = blocks.where("block = 0").join(more, F.col("group") == F.col("_group"), "left")
    first = first.select("group", "block", F.col("_more").isNull().alias("alone"), "members")
    return first.unionByName(blocks.where("block > 0").select("group", "block", F.lit(False).alias("alone"), "members"))


def _climb(nodes: DataFrame, tables: Scratch) -> list[DataFrame]:
    """Rounds of blocks from the leaves to the top of every group."""
    rounds = []
    while True:
        blocks = _levelled(_blocks(nodes, tables))
        rounds.append(blocks)
        above = blocks.where(~F.col("alone"))
        if above.isEmpty():
            return rounds
        nodes = above.select("group", F.col("block").alias("pos"), F.col("top").alias("node"), F.lit(None).cast("string").alias("load"))


_PATH = "array<struct<left:string,right:string>>"


def _descend(rounds: list[DataFrame], beyond: DataFrame | None, tables: Scratch) -> DataFrame:
    """The leaves' blocks with ``path`` (the siblings above the block), ``subroot`` and ``root``.

    ``beyond``: (group, path, root) above the groups' tops; without it the top is the root.
    """
    upper = None
    for blocks in reversed(rounds):
        tops = blocks.where("alone")
        if beyond is None:
            tops = tops.select("*", F.array().cast(_PATH).alias("path"), F.col("top").alias("root"))
        else:
            tops = tops.join(beyond, "group").select(*tops.columns, "path", "root")
        placed = tops.withColumn("subroot", F.col("top"))
        if upper is not None:
            placed = placed.unionByName(blocks.where(~F.col("alone")).join(upper, ["group", "block"]))
        if blocks is rounds[0]:
            return placed
        paths = F.transform("members", lambda m, i: F.struct(m["pos"].alias("block"), F.concat(_siblings(F.col("runs"), i), F.col("path")).alias("path")))
        upper = tables.keep(placed.select("group", "subroot", "root", F.explode(paths).alias("m")).select("group", F.col("m.block").alias("block"), "m.path", "subroot", "root"))


def _folded(node: Column, path: Column) -> Column:
    return F.aggregate(path, node, lambda digest, s: _digest(F.concat(s["left"], digest, s["right"])))


def manifest(docs: DataFrame, tampered: Column | None = None, key: str = "doc_id", lang: str = "lang", fields: tuple[str, ...] = FIELDS,
             paths: bool = True) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and path unless ``paths`` is false.

    ``path``: the siblings from the leaf to the root, (left, right) hex digits a level.  ``tampered``: a digest to be
    folded instead of a row's leaf where it is not NULL (an expression over the columns of ``docs``, say ``leaf_digest`` of changed fields).
    """
    own = leaf_digest([F.col(f"`{f}`") for f in fields])
    other = F.lit(None).cast("string") if tampered is None else tampered
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{lang}`").cast("string")), F.lit(""))
    leaves = docs.select(group.alias("group"), F.col(f"`{key}`").alias("doc_id"), own.alias("leaf"), other.alias("other"))
    with Scratch() as tables:
        placed = running_totals(leaves, ["group"], [F.col("doc_id"), F.col("leaf")], {"pos": F.lit(1)}, docs.count(), tables)
        load = F.struct("doc_id", "other")
        rounds = _climb(placed.select("group", "pos", F.col("leaf").alias("node"), load.alias("load")), tables)
        tops = None
        for blocks in rounds:
            found = blocks.where("alone").select(F.col("group").alias("load"), F.col("top").alias("node"))
            tops = found if tops is None else tops.unionByName(found)
        tops = tables.keep(tops)
        ordered = running_totals(tops, [], [F.col("load")], {"pos": F.lit(1)}, tops.count(), tables)
        languages = _descend(_climb(ordered.select(F.lit("").alias("group"), "pos", "node", "load"), tables), None, tables)
        above = F.transform("members", lambda m, i: F.struct(m["load"].alias("group"), F.concat(_siblings(F.col("runs"), i), F.col("path")).alias("path")))
        beyond = tables.keep(languages.select("root", F.explode(above).alias("m")).select("m.group", "m.path", "root"))
        placed = _descend(rounds, beyond, tables)
        rows = F.transform("members", lambda m, i: F.struct(m["load"]["doc_id"].alias("doc_id"), m["node"].alias("leaf"), m["load"]["other"].alias("other"),
                                                            F.concat(_siblings(F.col("runs"), i), F.col("path")).alias("path")))
        rows = placed.select("subroot", "root", F.explode(rows).alias("m")).select("m.doc_id", "m.leaf", "m.other", "subroot", "root", "m.path")
        proof = _digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
        rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"),
                           _folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"), *(["path"] if paths else []))
        return reliable_checkpoint(rows.withColumn("verified", F.col("folded_root") == F.col("root")))


def lowered_leaf(every: int = 3, key: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> Column:
    """The contract's tampering: digest with A-Z of the text lower-cased where ``every`` divides the id's CRC-32; else NULL."""
    changed = [F.translate(F.col(f"`{f}`"), UPPER, LOWER) if f == "text" else F.col(f"`{f}`") for f in fields]
    return F.when(F.crc32(F.col(f"`{key}`").cast("string")) % every == 0, leaf_digest(changed))
