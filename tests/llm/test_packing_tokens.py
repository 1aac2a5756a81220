import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colscope.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aé '\n\t 　͸")), max_size=60))
def test_ids_are_the_library_s(text):
    model = bpe.load(bpe.read_spec(PATH))
    assert model.ids(text).tolist() == library_ids(text)
    assert sum(1 if isinstance(p, int) else sum(map(model.pieces, model.pre_tokens(p))) for p in model.parts(text)) == len(library_ids(text))


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", " " * 3000 + "x", "x" * 5000, "࢏Ᲊ new letters"])
def test_special_strings_and_runs(text):
    model = bpe.load(bpe.read_spec(PATH))
    assert model.ids(text).tolist() == library_ids(text)


def test_token_counts_odd_rows(table, odd_rows):
    got = sorted(map(tuple, token_counts.count_tokens(table(odd_rows), PATH, hot=50).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(library_ids(t))) for i, t in odd_rows), key=str)
    assert got == want
    # No map-side table at all gives the same.
    assert sorted(map(tuple, token_counts.count_tokens(table(odd_rows), PATH, hot=0).collect()), key=str) == want
    assert token_counts.count_tokens(table([]), PATH).collect() == []


def check_packing(rows, pieces, capacity):
    places = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for i, t in rows:
        ids = [*library_ids(t), 2]
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((p.doc_id, p.piece, p.start, p.length, zlib.crc32(bytes(p.ids))) for p in pieces if p.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert len(pieces) == len(want)
    return len(places)


def test_packing_odd_rows(table, odd_rows):
    pieces = packing.pack_documents(table(odd_rows), PATH, 64).collect()
    n = check_packing(odd_rows, pieces, 64)
    total = sum(len(library_ids(t)) + 1 for _, t in odd_rows)
    assert n <= -(-total // 64) + 4
    assert packing.pack_documents(table([]), PATH).collect() == []


def test_hot_length(table):
    """Copies of one length are ranges of ranks, whatever their number."""
    rows = [(k, "same words here") for k in range(500)] + [(1000 + k, "two words and some more of them " * (k % 7)) for k in range(200)]
    assert check_packing(rows, packing.pack_documents(table(rows), PATH, 32).collect(), 32) > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=24, max_size=24))
def test_plan_uses_every_piece_once(numbers):
    capacity = len(numbers)
    counts = [0, *numbers]
    plan = packing.plan_packing(counts, capacity)
    used = [0] * (capacity + 1)
    for lengths, times in plan:
        assert sum(lengths) <= capacity and times > 0
        for n in lengths:
            used[n] += times
    assert used == counts
    bound = -(-sum(n * c for n, c in enumerate(counts)) // capacity)
    sequences = sum(t for _, t in plan)
    assert sequences <= bound * 11 // 9 + 1 or sequences <= sum(c for n, c in enumerate(counts) if 2 * n > capacity) + bound // 4 + 2


def test_plan_prefers_exact_fillings():
    assert sorted(packing.plan_packing([0, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0], 10)) == [((5, 3, 2), 1)]
    counts = [0] * 101
    for n in (60, 40, 30, 20, 10):
        counts[n] = 6
    assert sum(t for _, t in packing.plan_packing(counts, 100)) == -(-6 * 160 // 100)


def test_segments_cover_ranks():
    plan = packing.plan_packing([0, 7, 5, 9, 2, 1, 0, 3, 4], 8)
    seen = {}
    for n, first, last, _, _ in packing._segments(plan):
        seen.setdefault(n, []).append((first, last))
    for n, parts in seen.items():
        at = 0
        for first, last in parts:
            assert first == at
            at = last + 1
        assert at == [0, 7, 5, 9, 2, 1, 0, 3, 4][n]
