"""Secret scans: base patterns, and formats inferred from the credentials that they find.

1. Every whole text is scanned for base spans and candidates: what the base spans leave of its runs of
   credential characters, ``RUN`` characters and more.
2. Of the distinct values of each base kind, a bounded sample (the smallest hashes) goes into a prefix tree over character
   classes.  States whose ending and continuing frequencies agree (Hoeffding's bound, the ALERGIA algorithm) are
   merged in breadth-first order; the result is a probabilistic automaton of the format.  Its frequencies are then counted
   over all values, by tasks.
3. Every candidate is scored by each automaton: log-likelihood per character against a
   background of all other candidates (pairs of neighbouring classes).  What comes nearer to the labelled values' scores
   (a low quantile of all of them) than to zero, where both models fit alike, becomes a span of kind ``format``, however many
   candidates do; the background is fitted again without what comes half as near, until that stays the same.

Defined results: NULL text counts as empty; every row gives one row, also rows that repeat or share a
doc_id; NULL doc_id stays NULL; without labelled values no span is added; empty in, empty out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import id_and_text, map_texts, release_memory, text_chunks
from colscope.session import Scratch

#: Base patterns, the least length of what they find, and the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "format")
#: Every assignment holds one of these, in lower case.
KEYS = ("passw", "secret", "token", "api")

#: Least length of a candidate run.
RUN = 8
#: Distinct values per kind that the states of an automaton come from, and the longest of them; its frequencies, the thresholds and the background come from all.
MAX_VALUES, MAX_LENGTH = 2_000, 256
#: Kind of other candidates, values that a task remembers before it puts them out, and width of the steps in which labelled scores are counted.
OTHER, HELD, STEP = "other", 50_000, 1e-4
#: Confidence of the merge test; quantile of the labelled scores that the threshold is half of; most fits of the background.
ALPHA, LABELLED_QUANTILE, MAX_FITS = 0.05, 0.05, 20
#: Verdicts on short class words that a task remembers.
MEMO = 50_000

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % RUN)


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; matches are leftmost and do not overlap within a kind."""
    out = []
    lowered = text.lower()
    if any(k in lowered for k in KEYS):
        out += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    # Keys and hexadecimal strings of such lengths lie within a run of credential characters.
    for a, b in candidate_runs(text) if runs is None else runs:
        if b - a < LEAST["access"]:
            continue
        for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
            out += [(kind, *m.span(), m[0]) for m in pattern.finditer(text, a, b) if len(m[0]) >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidate_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def candidates(spans: list[tuple[str, int, int, str]], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans leave of the runs (both in order of their starts), in pieces of ``RUN`` characters and more."""
    taken: list[list[int]] = []
    for _, a, b, _ in spans:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, first = [], 0
    for a, b in runs:
        while first < len(taken) and taken[first][1] <= a:
            first += 1
        at, k = a, first
        while k < len(taken) and taken[k][0] < b:
            if taken[k][0] - at >= RUN:
                out.append((at, taken[k][0]))
            at, k = taken[k][1], k + 1
        if b - at >= RUN:
            out.append((at, b))
    return out


def char_class(c: str) -> str:
    """Small letters as hexadecimal digits or others, capitals likewise, digits; other characters stand for themselves."""
    if c.isdigit():
        return "0"
    if c.isalpha():
        return ("a" if c in "abcdef" else "g") if c.islower() else ("A" if c in "ABCDEF" else "G")
    return c


#: Classes that credential characters fall into.
CLASSES = "0agAG+/_.=-"
_TO_CLASS = {c: char_class(chr(c)) for c in range(128)}


def classes(value: str) -> str:
    """The value with each character replaced by its class."""
    return value.translate(_TO_CLASS)


@dataclass
class State:
    ends: int = 0
    passes: int = 0
    next: dict[str, int] = field(default_factory=dict)
    counts: Counter = field(default_factory=Counter)


class Automaton:
    """Deterministic probabilistic automaton, from a prefix tree by state merging."""

    def __init__(self, words: list[str], alpha: float = ALPHA) -> None:
        self.states = [State()]
        for word in words:
            at = 0
            for symbol in word:
                state = self.states[at]
                state.passes += 1
                state.counts[symbol] += 1
                if symbol not in state.next:
                    self.states.append(State())
                    state.next[symbol] = len(self.states) - 1
                at = state.next[symbol]
            self.states[at].passes += 1
            self.states[at].ends += 1
        self._width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self._width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = (self.states[i] for i in todo.pop())
            if self._differ(p.ends, p.passes, q.ends, q.passes):
                return False
            for symbol in p.counts.keys() | q.counts.keys():
                if self._differ(p.counts[symbol], p.passes, q.counts[symbol], q.passes):
                    return False
                if symbol in p.next and symbol in q.next:
                    todo.append((p.next[symbol], q.next[symbol]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            i, j = todo.pop()
            p, q = self.states[i], self.states[j]
            p.ends += q.ends
            p.passes += q.passes
            p.counts.update(q.counts)
            for symbol, child in q.next.items():
                if symbol in p.next:
                    todo.append((p.next[symbol], child))
                else:
                    p.next[symbol] = child

    def _merge_all(self) -> None:
        red, blue = [0], deque((0, s) for s in sorted(self.states[0].next))
        while blue:
            parent, symbol = blue.popleft()
            child = self.states[parent].next[symbol]
            if child in red:
                continue
            for state in red:
                if self._compatible(state, child):
                    self.states[parent].next[symbol] = state
                    self._fold(state, child)
                    break
            else:
                red.append(child)
            # Folding may hang new subtrees on any settled state.
            blue = deque((r, s) for r in red for s in sorted(self.states[r].next) if self.states[r].next[s] not in red)
        self.red = red
        # Where a symbol leads from the state that saw it most: the way back for words that leave the automaton.
        self._back: dict[str, int] = {}
        for state in sorted(red, key=lambda r: self.states[r].passes):
            self._back.update(self.states[state].next)

    def transitions(self, word: str) -> Iterator[tuple[int, str]]:
        """(state, class that follows) along the word, "" at its end."""
        at = 0
        for symbol in word:
            yield at, symbol
            at = self.states[at].next.get(symbol, self._back.get(symbol, at))
        yield at, ""

    def recount(self, seen: dict[tuple[int, str], int]) -> None:
        """Replaces the frequencies by counted transitions; states and ways stay."""
        for state in self.red:
            self.states[state].ends, self.states[state].passes, self.states[state].counts = 0, 0, Counter()
        for (at, symbol), n in seen.items():
            state = self.states[at]
            state.passes += n
            if symbol:
                state.counts[symbol] += n
            else:
                state.ends += n

    def log_likelihood(self, word: str) -> float:
        """Natural logarithm, with one added occurrence for each class and for the end."""
        at, total, spread = 0, 0.0, len(CLASSES) + 1
        for symbol in word:
            state = self.states[at]
            total += math.log((state.counts[symbol] + 1) / (state.passes + spread))
            at = state.next.get(symbol, self._back.get(symbol, at))
        return total + math.log((self.states[at].ends + 1) / (self.states[at].passes + spread))


@dataclass
class Formats:
    """Automata of the kinds with their thresholds, and the background."""

    background: dict[tuple[str, str], float]
    automata: list[tuple[Automaton, float]]
    _known: dict[str, bool] = field(default_factory=dict, repr=False)

    def matches(self, value: str) -> bool:
        word = classes(value)
        found = self._known.get(word)
        if found is None:
            found = any(score(word, a, self.background) >= least for a, least in self.automata)
            if len(word) <= 32:  # words of a language come again and again
                if len(self._known) >= MEMO:
                    self._known.clear()
                self._known[word] = found
        return found


def score(word: str, automaton: Automaton, background: dict[tuple[str, str], float]) -> float:
    return against(word, automaton.log_likelihood(word), background)


def against(word: str, likelihood: float, background: dict[tuple[str, str], float]) -> float:
    return (likelihood - sum(background[p] for p in zip("^" + word, word))) / len(word)


def _quantile(values: list[float], q: float) -> float:
    return sorted(values)[min(len(values) - 1, int(q * len(values)))]


def _pairs(words: Iterable[tuple[str, int]]) -> Counter:
    """Pairs of neighbouring classes of counted words."""
    out = Counter()
    for word, n in words:
        for p in zip("^" + word, word):
            out[p] += n
    return out


def _background(pairs: Counter) -> dict[tuple[str, str], float]:
    firsts = Counter()
    for (a, _), n in pairs.items():
        firsts[a] += n
    return {(a, b): math.log((pairs[a, b] + 1) / (firsts[a] + len(CLASSES))) for a in "^" + CLASSES for b in CLASSES}


def _fitted(automata: list[Automaton], others: Callable[[dict | None, list[float]], Counter], labelled: Callable[[dict], list[float]]) -> Formats:
    """Thresholds by the labelled values' scores alone; the background is fitted on what stays below half of each threshold.

    ``others`` gives the pairs of other candidates that stay below half of the thresholds against a background (None: of all),
    ``labelled`` the low quantile of each automaton's own scores.
    """
    rest = others(None, [])
    for _ in range(MAX_FITS):
        background = _background(rest)
        leasts = [max(0.0, low / 2) for low in labelled(background)]
        left = others(background, leasts)
        if left == rest:
            break
        rest = left
    return Formats(background, list(zip(automata, leasts)))


def learn_formats(labelled: dict[str, list[str]], others: list[str]) -> Formats:
    """Formats of values at hand."""
    others = [classes(w) for w in others]
    known = [[classes(w) for w in sorted(labelled[kind])] for kind in sorted(labelled) if labelled[kind]]
    automata = [Automaton(words) for words in known]

    def pairs(background: dict | None, leasts: list[float]) -> Counter:
        return _pairs((w, 1) for w in others if not any(score(w, a, background) > least / 2 for a, least in zip(automata, leasts)))

    return _fitted(automata, pairs, lambda background: [_quantile([score(w, a, background) for w in words], LABELLED_QUANTILE) for words, a in zip(known, automata)])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, word) of all values and other candidates, each once as far as the task remembers."""
    def rows(held: set) -> pa.RecordBatch:
        pairs = sorted(held)
        return pa.record_batch([pa.array(c, pa.string()) for c in ([k for k, _ in pairs], [v for _, v in pairs], [classes(v) for _, v in pairs])], ["kind", "value", "word"])

    held: set[tuple[str, str]] = set()
    for _, texts in text_chunks(batches):
        for text in texts:
            runs = candidate_runs(text)
            spans = base_spans(text, runs)
            held.update((kind, value) for kind, _, _, value in spans)
            held.update((OTHER, text[a:b]) for a, b in candidates(spans, runs))
        if len(held) >= HELD:
            yield rows(held)
            held.clear()
    yield rows(held)
    release_memory()


class Smallest:
    """The ``bound`` distinct values of the smallest hashes (CRC-32, then the value) among those added."""

    def __init__(self, bound: int) -> None:
        self.bound, self._values, self._last = bound, set(), (1 << 32, "")

    def add(self, value: str) -> None:
        if len(value) <= MAX_LENGTH and value not in self._values:
            place = (zlib.crc32(value.encode()), value)
            if place < self._last:
                self._values.add(value)
                if len(self._values) >= 2 * self.bound:
                    self._cut()

    def _cut(self) -> None:
        kept = self.sorted()
        self._values, self._last = {v for _, v in kept}, kept[-1]

    def sorted(self) -> list[tuple[int, str]]:
        return sorted((zlib.crc32(v.encode()), v) for v in self._values)[:self.bound]


def _sampled(batches: Iterator[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    """(kind, place, value): the task's values of the smallest hashes, by kind."""
    kept = {kind: Smallest(bound) for kind in LEAST}
    for batch in batches:
        for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist()):
            kept[kind].add(value)
    for kind, smallest in kept.items():
        rows = smallest.sorted()
        yield pa.record_batch([pa.array([kind] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())],
                              ["kind", "place", "value"])


def _counted(batches: Iterator[pa.RecordBatch], automata: dict[str, Automaton]) -> Iterator[pa.RecordBatch]:
    """(kind, state, symbol, n): transitions of the labelled words."""
    seen = Counter()
    for batch in batches:
        for kind, word, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "word", "n"))):
            for at, symbol in automata[kind].transitions(word):
                seen[kind, at, symbol] += n
    rows = list(seen)
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()),
                           pa.array(list(seen.values()), pa.int64())], ["kind", "state", "symbol", "n"])


def _likelihoods(batches: Iterator[pa.RecordBatch], automata: dict[str, Automaton]) -> Iterator[pa.RecordBatch]:
    """Words with their log-likelihoods: labelled ones by their own kind's automaton, others by each."""
    for batch in batches:
        out = [[a.log_likelihood(word) for kind, a in automata.items() if own in (kind, OTHER)] for own, word in zip(batch.column("kind").to_pylist(), batch.column("word").to_pylist())]
        yield pa.record_batch([*(batch.column(c) for c in ("kind", "word", "n")), pa.array(out, pa.list_(pa.float64()))], ["kind", "word", "n", "fits"])


def _pairs_left(batches: Iterator[pa.RecordBatch], background: dict | None, leasts: list[float]) -> Iterator[pa.RecordBatch]:
    pairs = Counter()
    for batch in batches:
        pairs.update(_pairs((word, n) for word, n, fits in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "fits")))
                            if background is None or not any(against(word, fit, background) > least / 2 for fit, least in zip(fits, leasts))))
    yield pa.record_batch([pa.array(c, t) for c, t in (([a for a, _ in pairs], pa.string()), ([b for _, b in pairs], pa.string()), (list(pairs.values()), pa.int64()))], ["a", "b", "n"])


def _own_scores(batches: Iterator[pa.RecordBatch], background: dict) -> Iterator[pa.RecordBatch]:
    """(kind, step, n): labelled words by their score in whole steps."""
    steps = Counter()
    for batch in batches:
        for kind, word, n, fits in zip(*(batch.column(c).to_pylist() for c in ("kind", "word", "n", "fits"))):
            steps[kind, math.floor(against(word, fits[0], background) / STEP)] += n
    yield pa.record_batch([pa.array(c, t) for c, t in (([k for k, _ in steps], pa.string()), ([x for _, x in steps], pa.int64()), (list(steps.values()), pa.int64()))], ["kind", "step", "n"])


def _all_spans(text: str, formats: Formats) -> list[tuple[str, int, int]]:
    """(kind, start, end) of base and format spans, by start, then kind."""
    runs = candidate_runs(text)
    spans = base_spans(text, runs)
    out = [(kind, a, b) for kind, a, b, _ in spans]
    if formats.automata:
        out += [("format", a, b) for a, b in candidates(spans, runs) if formats.matches(text[a:b])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _scored(batches: Iterator[pa.RecordBatch], formats: Formats) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tags, at = batch.column(2), 0
        for ids, texts in text_chunks(iter([batch])):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in _all_spans(text, formats)] for text in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), tags.slice(at, len(ids)), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "tag", "spans"])
            at += len(ids)
    release_memory()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Formats:
    """Formats from all distinct values and candidates of all texts; only the automata's states come from bounded samples."""
    with Scratch() as tables:
        values = tables.keep(id_and_text(docs, key, text).mapInArrow(_values, "kind string, value string, word string").distinct())
        sampled = tables.keep(values.where(F.col("kind") != OTHER).mapInArrow(lambda it: _sampled(it, MAX_VALUES), "kind string, place long, value string"))
        automata = {}
        for kind in sorted(LEAST):
            sample = sampled.where(F.col("kind") == kind).orderBy("place", "value").limit(MAX_VALUES).collect()
            if sample:
                automata[kind] = Automaton([classes(v) for v in sorted(r["value"] for r in sample)])
        words = tables.keep(values.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n")))
        labelled, other = F.col("kind").isin(list(automata)), F.col("kind") == OTHER
        seen: dict[str, dict] = {kind: {} for kind in automata}
        if automata:
            counted = words.where(labelled).mapInArrow(lambda it: _counted(it, automata), "kind string, state int, symbol string, n long")
            for r in counted.groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n")).collect():
                seen[r["kind"]][r["state"], r["symbol"]] = r["n"]
            for kind, automaton in automata.items():
                automaton.recount(seen[kind])
        fits = tables.keep(words.where(labelled | other).mapInArrow(lambda it: _likelihoods(it, automata), "kind string, word string, n long, fits array<double>"))

        def pairs(background: dict | None, leasts: list[float]) -> Counter:
            left = fits.where(other).mapInArrow(lambda it: _pairs_left(it, background, leasts), "a string, b string, n long")
            return Counter({(r["a"], r["b"]): r["n"] for r in left.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()})

        def lows(background: dict) -> list[float]:
            if not automata:
                return []
            steps = fits.where(~other).mapInArrow(lambda it: _own_scores(it, background), "kind string, step long, n long")
            rows = steps.groupBy("kind", "step").agg(F.sum("n").alias("n")).collect()
            return [_low([(r["step"], r["n"]) for r in rows if r["kind"] == kind]) for kind in automata]

        return _fitted(list(automata.values()), pairs, lows)


def _low(steps: list[tuple[int, int]]) -> float:
    """The low quantile of scores counted by steps, at the step's lower end."""
    total = sum(n for _, n in steps)
    rank, seen = min(total - 1, int(LABELLED_QUANTILE * total)), 0
    for step, n in sorted(steps):
        seen += n
        if seen > rank:
            return step * STEP
    raise ValueError("no scores")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, tag (hash of the text), spans: array of (kind, start, end) in code points."""
    formats = fit(docs, key, text)
    rows = id_and_text(docs, key, text).select("doc_id", "text", F.xxhash64("text").alias("tag"))
    return rows.mapInArrow(lambda it: _scored(it, formats), "doc_id long, tag long, spans array<struct<kind:string,start:int,end:int>>")


def redacted(text: str, formats: Formats, mark: str) -> str:
    """The text with each maximal overlap of base and format spans replaced by ``mark``."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in _all_spans(text, formats)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", mark: str = "<secret>") -> DataFrame:
    """All rows and columns of ``docs``; secrets in the text are replaced by ``mark``, and ``length`` (if there) follows."""
    formats = fit(docs, key, text)
    rows = map_texts(docs, text, lambda: lambda texts: pa.array([None if t is None else redacted(t, formats, mark) for t in texts], pa.string()), "string", pa.string())
    rows = rows.withColumnRenamed("out", "clean")
    changed = {text: F.col("clean")}
    if length in docs.columns:
        new = F.length("clean").cast(docs.schema[length].dataType)
        changed[length] = F.when(F.col("clean") == F.col(f"row.`{text}`"), F.col(f"row.`{length}`")).otherwise(new)
    return rows.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def span_digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
