"""Benchmark decontamination by latent semantic retrieval.

1. Terms: all words of the benchmark and the most frequent ones of all documents, with their document frequencies.
2. Passages (word windows) of all documents, weighted by TF-IDF, form a matrix; a randomised singular value decomposition
   with one power iteration, its products summed over Spark tasks, gives their main directions.  These and the items of the benchmark,
   which are held exactly, give the latent space by a second decomposition.  A benchmark of more items than a space
   has dimensions for goes in blocks, each with its own space; every document is searched for every block.
3. Every document is cut into overlapping windows of several sizes.  A window whose words cannot reach the threshold
   in the latent space, whatever the item (a bound from three running sums), is passed over; the others are compared with all items by
   cosine, the items being a broadcast query set.
4. A candidate is confirmed by the longest common subsequence of words of the item and the
   text around the window, and by the item's answer: of its last content words (those above
   the item's median weight), enough must stand there.

Defined results: NULL text counts as empty and hits nothing; NULL or wordless items are no items; items with
the same id are checked each and the best hit counts; rows that share a doc_id give one row per item; a NULL doc_id gives
rows with NULL doc_id; empty documents or benchmark give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import id_and_text, map_texts, release_memory, task_number, text_chunks
from colscope.llm.sampling import bounded_sample  # noqa: F401 (nothing is sampled here any more; a test of the terms replaces it)
from colscope.session import Scratch, reliable_checkpoint

#: Least window size in words, and from one size to the next; a window starts every half size.
LEAST_SIZE, SIZE_STEP = 8, 3
#: The most frequent words of all documents among the terms.
CORPUS_TERMS = 8_192
#: Weight of an item in the latent space against as many documents; more documents raise it in proportion, so items keep their share of the space.
ITEM_WEIGHT, SAMPLE_DOCS = 100.0, 512
#: Aimed words of a row of numbered passages, words of windows that a task multiplies at a time, and tasks whose products are summed at a time.
PIECE_WORDS, HELD_WINDOWS, SUMMED_TASKS = 8_192, 131_072, 32
#: Counts of words that a task holds before it sums them and puts them out.
HELD_WORDS = 500_000
#: Dimensions of the latent space beyond one per item, their most (more items are searched in blocks), and additional random directions.
EXTRA_RANK, MAX_RANK, OVERSAMPLE = 32, 512, 16
#: Least cosine of a candidate, least share of the item in the common subsequence, answer words and how many must be found.
COSINE, COMMON, ANSWER_WORDS, ANSWER_FOUND = 0.4, 0.6, 5, 3
#: Terms whose rows travel together when products are summed.
_BLOCK = 1024
#: Punctuation that is no part of a word at its ends.
_STRIP = ".,;:!?\"'()[]{}|#$%&*<>-_"


def bare_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Normalised words of texts, as they are compared (lower case, no punctuation around them), one text after the other; where each text's words end."""
    lower = pa.array([t.lower().encode("utf-8", "surrogatepass") for t in texts], pa.binary()).view(pa.string())
    raw = pc.ascii_split_whitespace(lower)
    words = pc.ascii_trim(raw.flatten(), _STRIP)
    some = pc.not_equal(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
    return words.filter(some).view(pa.binary()), before[raw.offsets.to_numpy()[1:]]


def words_of(text: str) -> list[bytes]:
    """Normalised words of a text."""
    return bare_words([text])[0].to_pylist()


class _Numbers:
    """Numbers of the terms of texts, 0 for other words."""

    def __init__(self, terms: dict[bytes, int]) -> None:
        self.words = pa.array(list(terms), pa.binary())
        self.numbers = np.array([0, *terms.values()], np.int32)

    def each(self, texts: list[str]) -> list[np.ndarray]:
        words, ends = bare_words(texts)
        numbers = self.numbers[pc.index_in(words, self.words).fill_null(-1).to_numpy() + 1]
        return [numbers[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def of(self, text: str) -> np.ndarray:
        return self.each([text])[0]


def window_starts(n: int, size: int) -> np.ndarray:
    """Starts of windows of one size every half size; the last one ends with the text."""
    if n <= size:
        return np.zeros(1 if n else 0, dtype=np.int64)
    return np.append(np.arange(0, n - size, size // 2), n - size)


def window_sizes(lengths: list[int]) -> list[int]:
    """Sizes from the shortest item's length on, until they reach the longest one's third."""
    sizes = [max(LEAST_SIZE, min(lengths))]
    while sizes[-1] * SIZE_STEP <= max(lengths):
        sizes.append(sizes[-1] * SIZE_STEP)
    return sizes


@dataclass
class Index:
    """Latent space and items, as every task gets them."""

    terms: dict[bytes, int]
    sizes: list[int]
    idf: np.ndarray
    space: np.ndarray
    item_ids: list[int]
    items: list[list[bytes]]
    latent: np.ndarray
    answers: list[set[bytes]]

    def reach(self) -> np.ndarray:
        """The most that one occurrence of each term can add to the product with any item."""
        out = np.zeros(len(self.idf))
        for first in range(0, len(self.item_ids), _BLOCK):
            out = np.maximum(out, (self.space @ self.latent[first:first + _BLOCK].T).max(axis=1))
        return self.idf * out

    def length(self, numbers: np.ndarray) -> float:
        """TF-IDF length of a bag of terms; every word without a term counts once, at the highest weight."""
        found, tf = np.unique(numbers, return_counts=True)
        squares = (tf * self.idf[found].astype(np.float64)) ** 2
        squares[found == 0] /= tf[found == 0]
        return float(np.sqrt(squares.sum()))


def _text_counts(texts: list[str]) -> pa.Table:
    """(word, n): how many of the texts hold the word."""
    words, ends = bare_words(texts)
    coded, bits = words.dictionary_encode(), len(texts).bit_length()
    holders = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    pairs = np.sort(coded.indices.to_numpy().astype(np.int64) << bits | holders)
    first = np.diff(pairs, prepend=-1) != 0
    return pa.table({"word": coded.dictionary, "n": np.bincount(pairs[first] >> bits, minlength=len(coded.dictionary))})


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): texts that hold the word, in parts that a task can hold."""
    def summed() -> list[pa.RecordBatch]:
        total = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return total.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    held, size = [], 0
    for _, texts in text_chunks(batches):
        held.append(_text_counts(texts))
        size += len(held[-1]) + 1
        if size >= HELD_WORDS:
            yield from summed()
            held, size = [], 0
    if held:
        yield from summed()
    release_memory()


def _window_scales(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """One by the squared TF-IDF length of each window, words without a term left out; 0 without any term."""
    lengths = ends - starts
    places = np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    found = numbers[places].astype(np.int64)
    pairs = np.sort((np.repeat(np.arange(len(starts)), lengths) * len(idf) + found)[found > 0])
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    weights = np.diff(first, append=len(pairs)) * idf[pairs[first] % len(idf)].astype(np.float64)
    squares = np.bincount(pairs[first] // len(idf), weights * weights, minlength=len(starts))
    return np.divide(1.0, squares, out=np.zeros(len(starts)), where=squares > 0)


_PIECES = "numbers binary, starts binary, ends binary, scales binary"


def _numbered(batches: Iterator[pa.RecordBatch], terms: dict[bytes, int], idf: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Words of texts as numbers, about ``PIECE_WORDS`` a row, with the starts, ends and scales of their windows (a long text's windows fill several rows)."""
    lookup, most = _Numbers(terms), max(1, PIECE_WORDS // max(1, size // 2))

    def row(pieces: list) -> tuple:
        begun = np.cumsum([0, *(len(p) for p, _ in pieces)])
        starts = np.concatenate([s + b for (_, s), b in zip(pieces, begun)])
        ends = np.concatenate([np.minimum(s + size, len(p)) + b for (p, s), b in zip(pieces, begun)])
        numbers = np.concatenate([p for p, _ in pieces])
        return numbers.tobytes(), starts.astype(np.int32).tobytes(), ends.astype(np.int32).tobytes(), _window_scales(numbers, starts, ends, idf).tobytes()

    for _, texts in text_chunks(batches):
        rows, pieces, words = [], [], 0
        for numbers in lookup.each(texts):
            starts = window_starts(len(numbers), size)
            for run in (starts[k:k + most] for k in range(0, len(starts), most)):
                pieces.append((numbers[run[0]:run[-1] + size], run - run[0]))
                words += len(run) * max(1, size // 2)
                if words >= PIECE_WORDS:
                    rows.append(row(pieces))
                    pieces, words = [], 0
        if pieces:
            rows.append(row(pieces))
        if rows:
            yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*rows)], ["numbers", "starts", "ends", "scales"])
    release_memory()


def _add_by_term(out: np.ndarray, terms: np.ndarray, counts: np.ndarray, rows: np.ndarray, places: np.ndarray) -> None:
    """Adds to each term's row the sum of its rows: ``counts`` of them, at ``places``, term after term.  Four are summed at a time, by matrix products."""
    four = np.ones((1, 4), rows.dtype)
    while True:
        single = counts == 1
        out[terms[single]] += rows[places[np.cumsum(counts)[single] - 1]]
        places, terms, counts = places[np.repeat(~single, counts)], terms[~single], counts[~single]
        if not len(terms):
            return
        groups = (counts + 3) // 4
        slots = np.full(4 * groups.sum(), len(rows))
        slots[np.arange(len(places)) + np.repeat(4 * (np.cumsum(groups) - groups) - np.cumsum(counts) + counts, counts)] = places
        filled = np.append(rows, np.zeros((1, rows.shape[1]), rows.dtype), axis=0).take(slots, axis=0)
        rows = np.matmul(four, filled.reshape(-1, 4, rows.shape[1]))[:, 0]
        places, counts = np.arange(len(rows)), groups


def _add_products(out: np.ndarray, weighted: np.ndarray, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, scales: np.ndarray) -> None:
    """Adds to each term's row the scaled products of the windows around its occurrences; ``weighted`` are what one occurrence adds to a product."""
    places = starts[:, None] + np.arange((ends - starts).max())
    places[places >= ends[:, None]] = len(numbers)
    terms = np.append(numbers, np.int32(0)).take(places)
    inside = np.matmul(np.ones((1, terms.shape[1]), np.float32), weighted.take(terms, axis=0))[:, 0]
    products = np.zeros((len(starts) + 1, weighted.shape[1]))
    np.cumsum(inside * scales[:, None], axis=0, out=products[1:])
    # Words between two neighbouring ends of windows stand in the same windows.
    edge = np.zeros(len(numbers) + 1, bool)
    edge[starts] = edge[ends] = True
    edges = np.flatnonzero(edge)
    around = (products[np.searchsorted(starts, edges, side="right")] - products[np.searchsorted(ends, edges, side="right")]).astype(np.float32)
    pairs = np.sort((numbers.astype(np.int64) * len(edges) + np.cumsum(edge[:-1]) - 1)[numbers > 0])
    found = pairs // len(edges)
    first = np.flatnonzero(np.diff(found, prepend=-1))
    _add_by_term(out, found[first], np.diff(first, append=len(pairs)), around, pairs - found * len(edges))


def _products(batches: Iterator[pa.RecordBatch], idf: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sum over a task's passages a of a (a' basis), by term."""
    weighted, out = idf[:, None] * basis, np.zeros(basis.shape)
    weighted[0] = 0
    held, windows, longest = [], 0, 0

    def add() -> None:
        begun = np.cumsum([0, *(len(numbers) for numbers, *_ in held)])
        numbers, starts, ends, scales = zip(*held)
        starts, ends = (np.concatenate([x + b for x, b in zip(part, begun)]) for part in (starts, ends))
        _add_products(out, weighted, np.concatenate(numbers), starts, ends, np.concatenate(scales))

    for batch in batches:
        for row in zip(*(batch.column(c) for c in range(4))):
            held.append([np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int32, np.int32, np.int32, np.float64))])
            windows, longest = windows + len(held[-1][1]), max(longest, int((held[-1][2] - held[-1][1]).max()))
            if windows * longest >= HELD_WINDOWS:
                add()
                held, windows, longest = [], 0, 0
    if held:
        add()
    out *= idf[:, None]
    blocks = [b for b in range(0, len(out), _BLOCK) if out[b:b + _BLOCK].any()]
    yield pa.record_batch([pa.array([task_number()] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()),
                           pa.array([out[b:b + _BLOCK].astype(np.float32).tobytes() for b in blocks], pa.binary())], ["task", "first", "rows"])
    release_memory()


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(r, np.float32).astype(np.float64) for r in group.column("rows").to_pylist())
    return pa.table({"first": group.column("first").slice(0, 1), "rows": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _gram_product(pieces: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(A'A) basis for the passages A of all documents."""
    shared = pieces.sparkSession.sparkContext.broadcast((idf, basis))
    parts = pieces.mapInArrow(lambda it: _products(it, *shared.value), "task int, first long, rows binary")
    for keys in (["first", F.floor(F.col("task") / SUMMED_TASKS)], ["first"]):
        parts = parts.groupBy(*keys).applyInArrow(_summed, "first long, rows binary")
    summed = parts.toArrow()
    shared.destroy()
    out = np.zeros(basis.shape, np.float64)
    for first, part in zip(summed.column("first").to_pylist(), summed.column("rows").to_pylist()):
        out[first:first + _BLOCK] = np.frombuffer(part, np.float32).reshape(-1, basis.shape[1])
    return out


def _main_directions(rows: DataFrame, terms: dict[bytes, int], idf: np.ndarray, size: int, seed: int) -> np.ndarray:
    """F with F F' near to A'A for the passages A of all documents: its range, one power iteration, and Nyström's formula on the last product."""
    width, spark = min(EXTRA_RANK + OVERSAMPLE, len(terms)), rows.sparkSession
    basis = np.random.default_rng(seed).standard_normal((len(terms) + 1, width)).astype(np.float32)
    basis[0] = 0
    with Scratch() as tables:
        shared = spark.sparkContext.broadcast((terms, idf, size))
        pieces = tables.keep(rows.select("doc_id", "text").mapInArrow(lambda it: _numbered(it, *shared.value), _PIECES))
        shared.destroy()
        basis = np.linalg.qr(_gram_product(pieces, idf, basis))[0].astype(np.float32)
        product = _gram_product(pieces, idf, basis)
    gram = basis.T.astype(np.float64) @ product
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    some = values > 1e-6 * max(values.max(), 0)
    return product @ (vectors[:, some] / np.sqrt(values[some]))


def _items(benchmark: DataFrame, item_key: str = "item_id", text: str = "text") -> list[tuple[int, list[bytes]]]:
    """Ids and words of all items that have both, by id."""
    collected = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null").toArrow()
    pairs = sorted((i, words_of(t)) for i, t in zip(collected.column(0).to_pylist(), collected.column(1).to_pylist()) if i is not None)
    return [(i, w) for i, w in pairs if w]


def _fit(rows: DataFrame, pairs: list, vocabulary: dict[bytes, None], df: dict[bytes, int], total: int, seed: int) -> Index:
    """Latent space of some items and all documents."""
    terms = {w: i + 1 for i, w in enumerate(vocabulary)}
    idf = np.maximum(np.log((total + 1) / (np.array([0, *(df[w] for w in terms)], np.int64) + 1)), 1e-2).astype(np.float32)
    idf[0] = np.log(total + 1)
    own = []
    for _, words in pairs:
        numbers = np.array([terms[w] for w in words])
        found, tf = np.unique(numbers, return_counts=True)
        weights = tf * idf[found]
        own.append((found, (weights / np.sqrt((weights ** 2).sum())).astype(np.float32)))
    sizes = window_sizes([len(w) for _, w in pairs])
    rank = min(len(pairs) + EXTRA_RANK, MAX_RANK, len(terms))
    # Items count as much as many passages together, so the space holds each of them.
    items = np.zeros((len(terms) + 1, len(pairs)))
    for k, (found, weights) in enumerate(own):
        items[found, k] = weights * np.sqrt(ITEM_WEIGHT * max(1.0, total / SAMPLE_DOCS))
    directions, values, _ = np.linalg.svd(np.hstack([_main_directions(rows, terms, idf, sizes[-1], seed), items]), full_matrices=False)
    space = directions[:, :min(rank, int((values > 1e-6 * values[0]).sum()))].astype(np.float32)
    latent = np.stack([weights @ space[found] for found, weights in own])
    answers = []
    for _, item in pairs:
        weights = [float(idf[terms[w]]) for w in item]
        least = sorted(weights)[len(weights) // 2]
        last = dict.fromkeys(w for w, x in zip(reversed(item), reversed(weights)) if x >= least)
        answers.append(set(list(last)[:ANSWER_WORDS]))
    return Index(terms, sizes, idf, space, [i for i, _ in pairs], [w for _, w in pairs], latent, answers)


def build_indexes(rows: DataFrame, benchmark: DataFrame, item_key: str = "item_id", text: str = "text", seed: int = 5) -> Iterator[Index]:
    """Indexes of blocks that together hold all items: latent spaces from all documents and the block's items."""
    pairs = _items(benchmark, item_key, text)
    if not pairs:
        return
    with Scratch() as tables:
        counts = tables.keep(rows.mapInArrow(_document_frequencies, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
        frequent = counts.orderBy(F.desc("n"), "word").limit(CORPUS_TERMS).toArrow().column("word").to_pylist()
        vocabulary = dict.fromkeys(w for _, words in pairs for w in words) | dict.fromkeys(frequent)
        terms = rows.sparkSession.createDataFrame(pa.table({"word": pa.array(list(vocabulary), pa.binary())}))
        counted = counts.join(F.broadcast(terms), "word").toArrow()
        numbers = dict(zip(counted.column("word").to_pylist(), counted.column("n").to_pylist()))
        df, total = {w: numbers.get(w, 0) for w in vocabulary}, rows.count()
        size = max(1, MAX_RANK - EXTRA_RANK)
        for first in range(0, len(pairs), size):
            block = pairs[first:first + size]
            yield _fit(rows, block, dict.fromkeys(w for _, words in block for w in words) | dict.fromkeys(frequent), df, total, seed)


def build_index(rows: DataFrame, benchmark: DataFrame, item_key: str = "item_id", text: str = "text", seed: int = 5) -> Index | None:
    """The only index of a benchmark that fits in one block; None without items."""
    indexes = list(build_indexes(rows, benchmark, item_key, text, seed))
    if len(indexes) > 1:
        raise ValueError("the benchmark needs several indexes, see build_indexes")
    return indexes[0] if indexes else None


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit sets over the positions of ``a``."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = 0
    for w in b:
        if (hits := places.get(w)) is not None:
            joined = row | hits
            row = joined & ~(joined - ((row << 1) | 1))
    return row.bit_count()


def text_hits(index: Index, numbers: np.ndarray, text: str, weighted: np.ndarray, reach: np.ndarray) -> dict[int, tuple[float, int, int]]:
    """By item's place: cosine, words of the common subsequence, answer words found, of the best confirmed window.

    ``numbers`` are those of the text's terms; ``weighted`` holds the latent vector of one occurrence of each term, ``reach`` the most that it adds for any item.
    """
    n = len(numbers)
    out: dict[int, tuple[float, int, int]] = {}
    if not n:
        return out
    energy, bound = np.zeros(n + 1), np.zeros(n + 1)
    np.cumsum(index.idf[numbers].astype(np.float64) ** 2, out=energy[1:])
    np.cumsum(reach[numbers], out=bound[1:])
    words: list[bytes] | None = None
    for size in index.sizes:
        starts = window_starts(n, size)
        ends = np.minimum(starts + size, n)
        # Repeated terms only make the length greater, so this is the most that any cosine can be.
        least = COSINE * np.sqrt(energy[ends] - energy[starts])
        able = np.flatnonzero(bound[ends] - bound[starts] >= least)
        for a, b, most in zip(starts[able].tolist(), ends[able].tolist(), least[able].tolist()):
            products = index.latent @ weighted[numbers[a:b]].sum(axis=0)
            if products.max() < most:
                continue
            cosines = products / index.length(numbers[a:b])
            for k in np.flatnonzero(cosines >= COSINE).tolist():
                words = words_of(text) if words is None else words
                item = index.items[k]
                around = words[max(0, a - len(item)):b + len(item)]
                common = common_words(item, around)
                found = len(index.answers[k] & set(around))
                if common >= COMMON * len(item) and found >= min(ANSWER_FOUND, len(index.answers[k])) and (float(cosines[k]), common) > out.get(k, (0.0, 0))[:2]:
                    out[k] = (float(cosines[k]), common, found)
    return out


def _hits(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    lookup, weighted, reach = _Numbers(index.terms), index.idf[:, None] * index.space, index.reach()
    for batch in batches:
        tags, at = batch.column(2).to_pylist(), 0
        for ids, texts in text_chunks(iter([batch])):
            rows = [(key, tag, index.item_ids[k], len(index.items[k]), common, found, cosine) for key, tag, text, numbers in zip(ids, tags[at:], texts, lookup.each(texts))
                    for k, (cosine, common, found) in text_hits(index, numbers, text, weighted, reach).items()]
            at += len(ids)
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "tag", "item_id", "item_words", "common_words", "answer_words", "cosine"])
    release_memory()


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document (with the hash of its text, tag) and benchmark item that it holds."""
    rows = id_and_text(docs, key, text)
    schema = "doc_id long, tag long, item_id long, item_words long, common_words long, answer_words long, cosine double"
    spark, parts = docs.sparkSession, []

    # Each block's hits are written before the next space is fitted, so a task holds one space.
    with Scratch() as tables:
        for index in build_indexes(rows, benchmark):
            shared = spark.sparkContext.broadcast(index)
            hits = rows.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(lambda it, shared=shared: _hits(it, shared), schema)
            parts.append(tables.keep(hits))
            shared.destroy()
        if not parts:
            return spark.createDataFrame([], schema)
        found = reduce(DataFrame.unionByName, parts)
        best = F.max(F.struct("common_words", "cosine", "answer_words", "item_words")).alias("best")
        return reliable_checkpoint(found.groupBy("doc_id", "tag", "item_id").agg(best).select(
            "doc_id", "tag", "item_id", *(F.col(f"best.{c}") for c in ("item_words", "common_words", "answer_words", "cosine"))))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    def free(rows: DataFrame, shared) -> DataFrame:
        def make():
            found: Index = shared.value
            lookup, weighted, reach = _Numbers(found.terms), found.idf[:, None] * found.space, found.reach()

            def held(texts: list) -> pa.Array:
                texts = [t or "" for t in texts]
                return pa.array([bool(text_hits(found, numbers, t, weighted, reach)) for t, numbers in zip(texts, lookup.each(texts))], pa.bool_())
            return held

        return map_texts(rows, text, make, "boolean", pa.bool_()).where(~F.col("out")).select("row.*")

    # What one block leaves is written before the next one's search, so a task holds one space; the last search stays lazy.
    kept, last, tables = docs, None, Scratch()
    for index in build_indexes(id_and_text(docs, key, text), benchmark):
        if last is not None:
            left = Scratch()
            kept = left.keep(free(kept, last))
            last.destroy()
            tables.drop()
            tables = left
        last = docs.sparkSession.sparkContext.broadcast(index)
    return kept if last is None else free(kept, last)
