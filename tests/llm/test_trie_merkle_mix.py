import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from texts import prose

from colscope.llm import merkle, mixing, running, trie
from colscope.session import Scratch

EXTRA = ["path", "low", "node", "root", "segment", "bucket", "group", "member", "_range", "size"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- running totals

def test_running_totals_split_hot_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE_ROWS", 7)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(5), rng.randrange(9)) for _ in range(300)] + [("hot", 3, 1)] * 200
    with Scratch() as tables:
        got = running.running_totals(spark.createDataFrame(rows, "g string, v int, w int"), ["g"], [F.col("v")], {"t": F.col("w"), "n": F.lit(1)}, len(rows), tables).collect()
    for group in ("a", "b", "hot", None):
        mine = sorted((r for r in got if r.g == group), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(len(mine))) and [r.v for r in mine] == sorted(r.v for r in mine)
        assert [r.t for r in mine] == [sum(m.w for m in mine[:k]) for k in range(len(mine))]


# ---------------------------------------------------------------- prefix trie

def brute_trie(rows, borrow=lambda c: 0, base=lambda c: c):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5((f"{len(role.encode())}:" + role + text).encode()).digest()
            turns[c].append(((turn is not None, turn or 0), mark, (role, text)))
    said = {c: [t for _, _, t in sorted(ts)] for c, ts in turns.items()}
    built = {c: said.get(base(c), [])[:borrow(c)] + own[borrow(c):] for c, own in said.items()}
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, ms in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(ms) - 1) * len(node[-1][1].encode().split()) if node else 0
    return sorted((min(ms), len(n), min(members[n[:-1]]) if n else None, len(ms), children[n], leaves[n], saved[n],
                   sha(",".join(map(str, sorted(c for c in ms if len(built[c]) == len(n)))))) for n, ms in members.items())


def nodes(spark, rows, **options):
    table = spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in EXTRA))
    got = trie.prefix_trie(table, **options).collect()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


ODD = [(1, None, None, None), (1, 0, "user", "hi there"), (1, 0, "user", "hi there"), (2, None, "", ""), (2, 0, "user", "hi there"), (None, 0, "user", "lost"),
       (-4, 5, "user", prose(1, 4000)), (-4, 5, "assistant", None), (9, 1, None, "a\nb  c"), (10, 1, "", "a\nb  c"), (11, 7, "a", "b"), (12, 7, "", "ab")]


def family(rng, convs=60, deepest=11):
    rows = []
    for c in range(convs):
        for turn in range(rng.randrange(1, deepest)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["one", "two words", "three words here"]) if turn < 9 else prose(c, 3)))
    return rows


def test_odd_turns(spark):
    assert nodes(spark, ODD) == brute_trie(ODD)
    assert nodes(spark, []) == []


@pytest.mark.parametrize("segment, rows_a_shard", [(64, 5_000), (64, 6), (3, 5_000), (3, 6), (1, 4)])
def test_shards_and_segments_change_nothing(spark, monkeypatch, segment, rows_a_shard):
    """Copies of one conversation over several shards, paths that end at a cut, and conversations much longer than a segment."""
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SHARD_ROWS", rows_a_shard)
    monkeypatch.setattr(trie, "CHUNK", 9)
    monkeypatch.setattr(trie, "_BUCKET", 4)
    rng = random.Random(segment)
    rows = family(rng) + [(1000 + c, turn, "user", f"copied {turn}") for c in range(40) for turn in range(6)]
    rows += [(2000 + c, turn, "user", f"copied {turn}") for c in range(3) for turn in range(6 + 3 * c)]
    borrow, base = (lambda c: zlib.crc32(str(c).encode()) % 4), (lambda c: c - c % 20)
    conv = F.col("conv")
    assert nodes(spark, rows, borrow=F.crc32(conv.cast("string")) % 4, base=conv - conv % 20) == brute_trie(rows, borrow, base)


def test_absent_lender_and_turnless_conversation(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(41, 60) for t in range(2)]
    borrow, base = (lambda c: zlib.crc32(str(c).encode()) % 4), (lambda c: c - c % 20)
    conv = F.col("conv")
    got = nodes(spark, rows, borrow=F.crc32(conv.cast("string")) % 4, base=conv - conv % 20)
    assert got == brute_trie(rows, borrow, base) and got[0][3] == 19


def test_long_conversation(spark):
    """Longer than a segment by far, beside a copy that parts from it late."""
    rows = [(c, t, "user", f"turn {t}" if c == 1 or t < 170 else f"other {t}") for c in (1, 2) for t in range(200)]
    assert nodes(spark, rows) == brute_trie(rows)


# ---------------------------------------------------------------- Merkle manifest

def brute_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows, tampered):
    def leaf(row, change):
        i, text, lang, n = row
        fields = [i, None, lang, n, text.translate(str.maketrans(merkle.UPPER, merkle.LOWER)) if change and text is not None else text]
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, False), leaf(row, tampered(row[0])), row[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: brute_levels([m[2] for m in sorted(by_lang[x], key=lambda m: m[:3])]) for x in langs}
    top = brute_levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for place, m in enumerate(sorted(by_lang[x], key=lambda m: m[:3])):
            node, proof = m[3], ""
            for levels, at in ((trees[x], place), (top, k)):
                for level in levels[:-1]:
                    run, own = level[at // 8 * 8:at // 8 * 8 + 8], at % 8
                    proof += "".join(run[:own] + run[own + 1:])
                    node = sha("".join([*run[:own], node, *run[own + 1:]]))
                    at //= 8
            out.append((m[4], m[2], trees[x][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest(spark, rows, **options):
    table = spark.createDataFrame([(i, t, x, n, None, *["x"] * len(EXTRA)) for i, t, x, n in rows],
                                  "doc_id long, text string, lang string, n_chars long, source string, " + ", ".join(f"`{c}` string" for c in EXTRA))
    got = merkle.manifest(table, merkle.lowered_leaf(3), **options).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str)


def lowered(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 0


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, None: 8, "de": 64}, {"en": 513, "de": 1, "fr": 65, "": 3, "\U0001f600": 2}])
def test_manifest(spark, monkeypatch, sizes):
    monkeypatch.setattr(running, "RANGE_ROWS", 50)
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"Text No. {i} naïve 東京", lang, i if i % 5 else None))
            i += 1
    random.Random(2).shuffle(rows)
    assert manifest(spark, rows, paths=False) == brute_manifest(rows, lowered)


def test_manifest_of_odd_rows(spark):
    rows = [(None, "A", "en", 1), (None, None, "en", None), (3, "", None, 0), (3, "", None, 0), (3, "B", None, 1), (7, prose(1, 50_000).upper(), "de", 9), (-8, "C", "en", 1)]
    assert manifest(spark, rows) == brute_manifest(rows, lowered)
    assert manifest(spark, []) == []
    rows = [(5, "same", "en", 4)] * 700
    assert manifest(spark, rows) == brute_manifest(rows, lowered)


def test_blocks_recur(spark, monkeypatch):
    """Many rounds of small blocks give the same tree, and the paths lead from the leaves to the root."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, f"t{i}", "en" if i % 3 else "de", i) for i in range(400)]
    assert manifest(spark, rows) == brute_manifest(rows, lowered)
    table = spark.createDataFrame([(i, t, x, n, None) for i, t, x, n in rows], "doc_id long, text string, lang string, n_chars long, source string")
    for r in merkle.manifest(table).collect():
        node = r.leaf
        for step in r.path:
            node = sha(step.left + node + step.right)
        assert node == r.root and r.verified


# ---------------------------------------------------------------- mixing

def brute_targets(sizes, weights=(5, 2, 1), ceiling=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, total = set(), sum(sizes.values())
    while True:
        rest = total - ceiling * sum(sizes[s] for s in fixed)
        open_weight = sum(weight[s] for s in names if s not in fixed)
        above = {s for s in names if s not in fixed and ceiling * sizes[s] * open_weight < rest * weight[s]}
        if not above:
            return {s: ceiling * sizes[s] if s in fixed else rest * weight[s] / open_weight for s in names}
        fixed |= above


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], "doc_id long, source string, text string, " + ", ".join(f"`{c}` string" for c in EXTRA))


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE_ROWS", 60)
    monkeypatch.setattr(mixing, "_BUCKET", 16)
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", "tiny", None]), prose(i, int(rng.paretovariate(1.1) * 20) % 3000)) for i in range(900)]
    rows = [r for r in rows if r[1] != "tiny"] + [(5000 + k, "tiny", "two words") for k in range(4)] + [(6000, "void", ""), (6001, "void", None)]
    docs = documents(spark, rows)
    plan = mixing.plan_mix(docs)
    got = plan.collect()
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
        largest[source] = max(largest[source], len((text or "").split()))
    want = brute_targets(sizes)
    assert len(got) == len(rows) and want["tiny"] == 24 and want["void"] == 0
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.plan_mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    emitted = mixing.emit_mix(docs, plan)
    assert emitted.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in emitted.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in got if r.copies}


def test_mix_of_odd_rows(spark):
    rows = [(None, None, None), (1, None, "a b"), (1, None, "a b"), (2, "s", " \t\n"), (3, "s", prose(3, 40_000)), (4, "t", "x")]
    docs = documents(spark, rows)
    plan = mixing.plan_mix(docs)
    got = plan.collect()
    assert len(got) == 6 and {r.source_size for r in got if r.source is None} == {4}
    assert mixing.emit_mix(docs, plan).count() == sum(r.copies for r in got if r.size) + sum(r.copies for r in got if not r.size)
    assert mixing.plan_mix(documents(spark, [])).collect() == []


def test_copies_of_a_row_are_emitted_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_COPIES", 5)
    docs = documents(spark, [(1, "s", "a b c")] * 17 + [(2, "t", prose(1, 200))])
    plan = mixing.plan_mix(docs)
    assert mixing.emit_mix(docs, plan).where("doc_id = 1").count() == sum(r.copies for r in plan.collect() if r.doc_id == 1)
