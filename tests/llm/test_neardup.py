import random

import pytest
from texts import prose

from colscope.llm import neardup


def shingles(text, width=4):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[k:] for k in range(width))))


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(names.get(find(k), i), i)
    return sorted(((i, len(sets[k]), names.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def found(docs):
    got = neardup.near_duplicates(docs).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def mutated(text, rng, share):
    return " ".join(w if rng.random() > share else rng.choice(["zeta", "omega", "kappa", "sigma"]) + str(rng.randrange(999)) for w in text.split())


def test_odd_rows(table, odd_rows):
    assert found(table(odd_rows)) == brute(odd_rows)
    assert neardup.near_duplicates(table([])).collect() == []


def test_chains_copies_and_shared_passages(table):
    rng = random.Random(9)
    passage, rows = prose(77, 70), []
    base = prose(50, 150)
    for k in range(60):  # near copies at all distances from the base, so that some are linked over others only
        rows.append((k, mutated(base, rng, 0.04 * (k % 5) / 2)))
    step = prose(51, 120).split()
    for k in range(12):  # a chain: each is like its neighbours
        rows.append((100 + k, " ".join([*step, *prose(600 + k, 8).split()][k * 6:])))
    rows += [(200 + k, prose(52, 90)) for k in range(30)]
    rows += [(300 + k, f"{prose(700 + k, 10 + 3 * k)} {passage} {prose(800 + k, 12)}") for k in range(40)]
    rows += [(400 + k, "too short") for k in range(3)] + [(410, "TOO short"), (411, "other")]
    assert found(table(rows)) == brute(rows)


@pytest.mark.parametrize("rounds", [0, 1])
def test_blocks_alone(table, monkeypatch, rounds):
    """Without hubs the blocks find every link, also if a list has many blocks."""
    monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng, base = random.Random(3), prose(60, 100)
    rows = [(k, mutated(base, rng, 0.02 * (k % 4))) for k in range(40)]
    assert found(table(rows)) == brute(rows)


def test_long_sets_are_estimated_without_loss(table):
    rng, base = random.Random(4), prose(61, 3000)
    rows = [(k, mutated(base, rng, 0.01 * (k % 6))) for k in range(14)] + [(50, prose(62, 3000))]
    assert found(table(rows)) == brute(rows)


def test_one_row_of_each_component_stays(table, odd_rows):
    docs = table(odd_rows)
    kept = neardup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = sorted([(i, t) for i, t in odd_rows if i not in (5, 6)] + [(5, odd_rows[5][1])], key=str)
    assert got == want


def test_least_overlap_is_exact_for_small_sets():
    assert [neardup.least_overlap(n, 64, 0.8) for n in (1, 5, 10, 50)] == [1, 4, 8, 40]
    assert all(neardup.least_overlap(n, 64, 0.8) <= -(-8 * n // 10) for n in range(1, 3000))


def test_blocks_put_out_spanning_edges_only():
    """20 copies in one block: 19 edges, not 190 pairs; already joined rows need none."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(1)
    base = rng.integers(-2**62, 2**62, 100)
    sketches = [np.unique(np.r_[base, rng.integers(-2**62, 2**62, 3)]) for _ in range(20)]
    rows = np.arange(20)

    def block(roots):
        return pa.table({"value": np.zeros(20, int), "row": rows, "root": roots, "side": np.full(20, 2), "sketch": pa.array([s.tolist() for s in sketches])})
    found = neardup._across(block(rows), 80)
    assert found.num_rows == 19 and neardup._across(block(np.zeros(20, int)), 80).num_rows == 0
    assert neardup._across(block(rows // 10), 80).num_rows == 1


def test_a_hub_of_many_documents_is_verified_in_groups(table, monkeypatch):
    monkeypatch.setattr(neardup, "HUB_PAIRS", 3)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rng, base = random.Random(8), prose(63, 100)
    rows = [(k, mutated(base, rng, 0.01)) for k in range(30)] + [(100 + k, prose(70 + k, 40)) for k in range(5)]
    assert found(table(rows)) == brute(rows)


def test_a_pair_of_many_lists_is_put_out_once(spark, monkeypatch):
    """12 long texts that are nearly alike in 30 lists each: 66 pairs to verify, not 66 a list; what the lists share stays connected."""
    import numpy as np
    rng = np.random.default_rng(2)
    base = rng.choice(2**40, 500, replace=False) - 2**39
    wide = [(k, np.unique(np.r_[base, rng.integers(2**41, 2**42, 40)])[:neardup.WIDE].tolist()) for k in range(12)]
    # Two short sets that are alike meet in the last list only.
    wide += [(12, list(range(50))), (13, list(range(1, 51)))]
    lists = [(v, k, k, 12) for v in range(30) for k in range(12)] + [(30, 12, 12, 2), (30, 13, 13, 2)]
    made, inner = spark.sparkContext.accumulator(0), neardup._across

    def counted(block, percent):
        out = inner(block, percent)
        made.add(out.num_rows)
        return out

    monkeypatch.setattr(neardup, "_across", counted)
    opened = spark.createDataFrame(lists, "value long, row long, root long, members long")
    pairs = neardup._block_pairs(opened, spark.createDataFrame(wide, "row long, sketch array<long>"), 80).collect()
    assert {(p.a, p.b) for p in pairs} == {(a, b) for a in range(12) for b in range(a)} | {(13, 12)}
    assert made.value == 67
