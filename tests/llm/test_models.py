import math
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import prose

from colscope.llm import bigru, decontaminate, toxicity


def items():
    return [(1, prose(900, 20)), (2, "A question: " + prose(901, 40) + "? " + prose(902, 6)), (3, prose(903, 60)), (4, None), (5, " \n"), (None, prose(904, 20)), (1, prose(905, 25))]


@pytest.fixture(scope="module")
def unusual():
    """Words of the items are rare in the documents, as they are in a corpus."""
    rng = random.Random(5)
    syllables = ["qua", "zor", "plim", "vex", "druth", "ony", "skel", "ibb", "wram", "tulo"]
    return lambda n: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(n))


def test_leaks(spark, table, odd_rows, unusual):
    passages = {k: unusual(n) for k, n in ((10, 15), (11, 24), (12, 45), (13, 59))}
    benchmark = spark.createDataFrame([*passages.items(), (14, None), (15, " \n")], "item_id long, text string")
    rng = random.Random(6)

    def paraphrase(text, share):
        return " ".join(w if rng.random() > share else prose(rng.randrange(10**6), 1) for w in text.split())
    rows = [*odd_rows]
    want = set()
    for n, (k, text) in enumerate(passages.items()):
        for copy in range(3):
            i = 1000 + 10 * n + copy
            rows.append((i, f"{prose(i, 40 * copy)} {text.upper() if copy == 1 else text}, {prose(i + 500, 300)}"))
            want.add((i, k))
        rows.append((1500 + n, f"{prose(n, 200)}\n{paraphrase(text, 0.2)}\n{prose(n + 50, 100)}"))
        want.add((1500 + n, k))
    rows += [(2000 + k, prose(2000 + k, 400)) for k in range(60)] + [(1000, rows[len(odd_rows)][1])]
    got = decontaminate.find_leaks(table(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.common_words <= r.item_words and r.cosine >= decontaminate.COSINE for r in got)
    docs = table(rows)
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if not any(i == d for d, _ in want))


def test_more_items_than_dimensions(monkeypatch, table, spark, unusual):
    """Verbatim copies are found whatever the size of the benchmark: 120 items, spaces of 62 dimensions at most."""
    monkeypatch.setattr(decontaminate, "MAX_RANK", 62)
    passages = [(k, unusual(20 + k % 30)) for k in range(120)]
    rows = [(k, f"{prose(k, 30)} {text} {prose(k + 500, 60)}") for k, text in passages] + [(1000 + k, prose(1000 + k, 100)) for k in range(120)]
    docs, benchmark = table(rows), spark.createDataFrame(passages, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()} == {(k, k) for k, _ in passages}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).collect()} == {i for i, _ in rows if i >= 1000}


def test_leaks_of_empty_tables(spark, table, odd_rows):
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    assert decontaminate.find_leaks(table([]), benchmark).collect() == []
    assert decontaminate.find_leaks(table(odd_rows), benchmark.limit(0)).collect() == []
    assert decontaminate.drop_leaks(table(odd_rows), benchmark.limit(0)).count() == len(odd_rows)


def test_bound_never_hides_a_window(spark, unusual):
    """The running-sum test passes every window whose cosine with some item reaches the threshold."""
    passages = [(k, unusual(20 + k)) for k in range(8)]
    docs = spark.createDataFrame([(k, prose(k, 200) + " " + passages[k % 8][1]) for k in range(60)], "doc_id long, text string")
    index = decontaminate.build_index(docs, spark.createDataFrame(passages, "item_id long, text string"))
    lookup, weighted, reach = decontaminate._Numbers(index.terms), index.idf[:, None] * index.space, index.reach()
    for r in docs.collect():
        numbers = lookup.of(r.text)
        for size in index.sizes:
            for a in decontaminate.window_starts(len(numbers), size):
                part = numbers[a:a + size]
                cosines = index.latent @ weighted[part].sum(axis=0) / index.length(part)
                if cosines.max() >= decontaminate.COSINE:
                    assert reach[part].sum() >= decontaminate.COSINE * np.sqrt((index.idf[part].astype(float) ** 2).sum()) - 1e-6


def test_common_words():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([bytes([rng.randrange(97, 101)]) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_words(a, b) == table[-1][-1]


def test_gradients(monkeypatch):
    monkeypatch.setattr(bigru, "WINDOW", 8)
    rng, model, types = np.random.default_rng(0), bigru.new_model(3), bigru.Types()
    docs = [types.numbers(t) for t in ("a bc d e f", "x yy zz a", "q w e r t y u")]
    for name in model.weights:
        model.weights[name] = (model.weights[name] + 0.1 * rng.standard_normal(model.weights[name].shape)).astype(np.float64)
    numbers, mask = bigru._batch(docs, [(0, 0), (1, 0), (2, 0)])
    product = model.inputs(bigru.word_features(list(types)))[1]
    labels = np.array([1.0, 0, 1])

    def loss():
        p = 1 / (1 + np.exp(-bigru.forward(model.weights, product, numbers, mask).astype(float)))
        return -np.where(labels > 0, np.log(p), np.log(1 - p)).sum()
    logits, passed = bigru.forward(model.weights, product, numbers, mask, trace=True)
    grads, d_x = bigru.gradients(model.weights, passed, (1 / (1 + np.exp(-logits)) - labels).astype(np.float32))
    grads["product"] = bigru._sums(numbers.ravel(), d_x.reshape(-1, d_x.shape[2]), len(product))
    for name, values in {"state": model.weights["state"], "attend": model.weights["attend"], "out": model.weights["out"], "product": product}.items():
        flat = values.reshape(-1)
        for k in rng.choice(flat.size, 6, replace=False):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - float(grads[name].reshape(-1)[k])) < 2e-3


def test_windows_cover_the_text():
    for n in (1, 5, 63, 64, 65, 96, 97, 500):
        starts = bigru.windows_of(n)
        covered = {j for s in starts for j in range(s, min(n, s + bigru.WINDOW))}
        assert covered == set(range(n)) and all(b - a <= bigru.STRIDE for a, b in zip(starts, starts[1:]))


def labelled(seed, n, bad_words):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words, toxic = prose(seed * 10_000 + k, rng.randrange(8, 200)).split(), k % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad_words))
        out.append((" ".join(words), int(toxic)))
    return out


def test_held_out_accuracy(spark, table, odd_rows):
    """Words with a stem that only label 1 has: seen words, and others with the same stem."""
    stems = [f"grum{e}" for e in ("bo", "la", "tch", "en", "ish", "or")]
    rows = labelled(1, 900, stems)
    docs = [(k, t) for k, (t, _) in enumerate(rows)]
    labels = spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(rows)] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    extra = [(i if i is None else 10_000 + i, t) for i, t in odd_rows]
    got = toxicity.score_documents(table(docs + extra), labels).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.score, rows[r.doc_id][1]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < len(rows)]
    assert len(held) > 120
    order = sorted(held)
    ranks = [k + 1 for k, (_, y) in enumerate(order) if y]
    auc = (sum(ranks) - len(ranks) * (len(ranks) + 1) / 2) / (len(ranks) * (len(held) - len(ranks)))
    assert auc > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id is not None and r.doc_id in (10_001, 10_002, 10_004))


def test_without_labels(spark, table, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(table(odd_rows), none).collect()
    assert len(got) == len(odd_rows) and all(r.predicted == 0 for r in got)
    assert toxicity.score_documents(table([]), none).collect() == []


def test_terms_are_the_most_frequent_words_of_all_documents(table, spark, monkeypatch):
    """A word of every document but those of the sample is a term, with its frequency in all of them."""
    monkeypatch.setattr(decontaminate, "CORPUS_TERMS", 2)
    monkeypatch.setattr(decontaminate, "SAMPLE_DOCS", 4)
    monkeypatch.setattr(decontaminate, "bounded_sample", lambda ids, key, bound: ids.where(F.col(key) < bound))
    docs = table([(k, f"Alpha, alpha unsampled w{k}" if k >= 4 else "alpha rare rarer") for k in range(40)]).select("doc_id", "text")
    benchmark = spark.createDataFrame([(1, "beta gamma w7 alpha delta epsilon zeta eta theta")], "item_id long, text string")
    index = decontaminate.build_index(docs, benchmark)
    assert b"unsampled" in index.terms and b"rare" not in index.terms
    weight = {w: round(float(index.idf[n]), 4) for w, n in index.terms.items()}
    assert [weight[w] for w in (b"unsampled", b"w7", b"beta")] == [round(math.log(41 / (n + 1)), 4) for n in (36, 1, 0)]


def test_words_without_a_call_each():
    """Seeing a word for the first time costs no Python call, neither when documents are counted nor when terms are looked up."""
    words = [f"W{k}" for k in range(20_000)]
    text, numbers, calls = ", ".join(words), decontaminate._Numbers({b"w7": 1, b"w19999": 2}), []
    batch = pa.record_batch([pa.array([1, 2]), pa.array([text, "W7 w7. -w8-"])], ["doc_id", "text"])
    sys.setprofile(lambda frame, event, arg: calls.append(event) if frame.f_code.co_filename == decontaminate.__file__ else None)
    try:
        got = numbers.of(text)
        counted = list(decontaminate._document_frequencies(iter([batch])))
    finally:
        sys.setprofile(None)
    assert len(calls) < 2_000
    assert len(got) == len(words) and {int(k): int(got[k]) for k in np.flatnonzero(got)} == {7: 1, 19_999: 2}
    counts = [(r["word"], r["n"]) for part in counted for r in part.to_pylist()]
    assert sorted(counts) == sorted((w.lower().encode(), 2 if w in ("W7", "W8") else 1) for w in words)


def test_bare_words(monkeypatch):
    """As words split and stripped one by one; counts in several parts add up to the texts that hold the word."""
    rng, characters = random.Random(3), [*" \t\n\r\x0b\x0c\x1c\x85\xa0.,;:!?\"'()[]{}|#$%&*<>-_@/\\~aA9\x00", "É", "ß", "İ", "Σ", "東", "\U0001f600", "\u0301", "\ud800"]
    plain = lambda t: [w for w in (x.strip(b".,;:!?\"'()[]{}|#$%&*<>-_") for x in t.lower().encode("utf-8", "surrogatepass").split()) if w]
    texts = ["", " ", "--", "a", *("".join(rng.choices(characters, k=rng.randrange(30))) for _ in range(2_000))]
    words, ends = decontaminate.bare_words(texts)
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip([0, *ends[:-1]], ends)] == [plain(t) for t in texts] == [decontaminate.words_of(t) for t in texts]
    assert len(decontaminate.bare_words([])[0]) == len(decontaminate._text_counts([])) == 0

    monkeypatch.setattr(decontaminate, "HELD_WORDS", 50)
    texts = [t for t in texts if "\ud800" not in t]
    batches = [pa.record_batch([pa.array(range(len(part))), pa.array(part, pa.string())], ["doc_id", "text"]) for part in (texts[k:k + 40] for k in range(0, len(texts), 40))]
    want, got = {}, {}
    for word in (w for t in texts for w in set(plain(t))):
        want[word] = want.get(word, 0) + 1
    parts = [part.to_pylist() for part in decontaminate._document_frequencies(iter(batches))]
    for row in (r for part in parts for r in part):
        got[row["word"]] = got.get(row["word"], 0) + row["n"]
    assert len(parts) > 5 and got == want


def _topics(table, spark):
    """Documents whose topic follows their number, the last one longer than 50,000 characters; a benchmark of one item."""
    topics = [[f"{name}{k}" for k in range(30)] for name in ("near", "far", "long")]
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(topics[k >= 4], k=60))) for k in range(80)] + [(80, " ".join(rng.choices(topics[2], k=12_000)))]
    return table(rows), spark.createDataFrame([(1, "beta gamma alpha delta epsilon zeta eta theta iota kappa")], "item_id long, text string")


def test_latent_space_comes_from_all_documents(table, spark, monkeypatch):
    """Words that stand only in documents that a sample would leave out, or in a very long one, have their place in the space."""
    monkeypatch.setattr(decontaminate, "SAMPLE_DOCS", 4)
    monkeypatch.setattr(decontaminate, "bounded_sample", lambda ids, key, bound: ids.where(F.col(key) < bound))
    docs, benchmark = _topics(table, spark)
    index = decontaminate.build_index(docs.select("doc_id", "text"), benchmark)
    for name in (b"near", b"far", b"long"):
        places = [index.terms[w] for w in index.terms if w.startswith(name)]
        assert len(places) == 30 and all(np.linalg.norm(index.space[places], axis=1) > 1e-3)


def test_dropped_leaks_are_judged_in_a_space_of_all_documents(table, spark, monkeypatch):
    """The pipeline's stage: the space that its rows are held against knows every document, and the one with the item goes."""
    monkeypatch.setattr(decontaminate, "bounded_sample", lambda ids, key, bound: ids.where(F.col(key) < 4))
    docs, benchmark = _topics(table, spark)
    leak = docs.where("doc_id = 7").withColumn("doc_id", F.lit(99).cast("long")).withColumn("text", F.concat("text", F.lit(" beta gamma alpha delta epsilon zeta eta theta iota kappa")))
    built, build = [], decontaminate.build_indexes
    monkeypatch.setattr(decontaminate, "build_indexes", lambda *args: (built.append(index) or index for index in build(*args)))
    assert {r.doc_id for r in decontaminate.drop_leaks(docs.unionByName(leak), benchmark).collect()} == set(range(81))
    places = [n for w, n in built[0].terms.items() if w.startswith((b"far", b"long"))]
    assert len(places) == 60 and all(np.linalg.norm(built[0].space[places], axis=1) > 1e-3)


@pytest.mark.parametrize("piece, held", [(8_192, 131_072), (100, 600)])
def test_products_are_those_of_every_window(spark, table, odd_rows, monkeypatch, piece, held):
    """As window by window; a text of more windows than a row holds goes over several rows."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    monkeypatch.setattr(decontaminate, "HELD_WINDOWS", held)
    texts = [t or "" for _, t in odd_rows] + ["the the the the a the", "w " * 40, prose(5, 400), prose(6, 45), prose(7, 46)]
    texts[9] = texts[9][:20_000]
    known = [w for w in dict.fromkeys(w for t in texts for w in decontaminate.words_of(t)) if len(w) % 4]
    terms = {w: k + 1 for k, w in enumerate(known)}
    rng = np.random.default_rng(2)
    idf, basis = rng.uniform(0.1, 5, len(terms) + 1).astype(np.float32), rng.standard_normal((len(terms) + 1, 5)).astype(np.float32)
    lookup, want = decontaminate._Numbers(terms), np.zeros(basis.shape)
    for text in texts:
        numbers = lookup.of(text)
        for a in decontaminate.window_starts(len(numbers), 45):
            found, tf = np.unique(numbers[a:a + 45], return_counts=True)
            weights = (tf * idf[found])[found > 0].astype(float)
            found = found[found > 0]
            if len(found):
                weights /= np.sqrt((weights ** 2).sum())
                want[found] += np.outer(weights, weights @ basis[found])
    halves = [pa.record_batch([pa.array(range(len(part))), pa.array(part, pa.string())], ["doc_id", "text"]) for part in (texts[:8], texts[8:])]
    rows = list(decontaminate._numbered(iter(halves), terms, idf, 45))
    assert piece > 1_000 or sum(r.num_rows for r in rows) > 20
    got = np.zeros(basis.shape)
    for part in decontaminate._products(iter(rows), idf, basis):
        for first, block in zip(part.column("first").to_pylist(), part.column("rows").to_pylist()):
            got[first:first + decontaminate._BLOCK] = np.frombuffer(block, np.float32).reshape(-1, 5)
    assert np.abs(got - want).max() <= 1e-5 * np.abs(want).max()
