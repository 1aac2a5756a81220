"""Quality rules: base rules, then a learned decision list of threshold conjunctions.

Text statistics come from one scan.  On a bounded sample of labelled rows, sequential covering grows a
conjunction of thresholds by information gain on two thirds of the rows, prunes it on the other third, keeps
it if it is precise enough there, removes the rows that it covers and starts again.  The rules become an ordered
CASE WHEN, so the verdict is a Spark expression over the statistics.

Defined results: NULL text counts as empty (no words, so it fails the base rules); a NULL doc_id
is kept as it is and carries no label; of labels that share a doc_id the lowest quality counts; rows that repeat are judged each on
its own; without labels the list is empty and the base rules decide alone; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import id_and_text, map_texts, release_memory, text_chunks
from colscope.llm.sampling import bounded_sample
from colscope.llm.words import ascii_words, window_hashes, word_hashes
from colscope.session import Scratch, reliable_checkpoint

#: Most labelled rows that the list is learned from.
MAX_LABELLED = 20_000
#: A rule must be right on this share of the pruning rows that it covers, and cover so many growing rows.
MIN_PRECISION, MIN_COVER = 0.97, 5
MAX_RULES, MAX_CONDITIONS = 24, 4
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_short_words", "longest_word")

_BYTES = np.arange(256)
_IS_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_IS_SYMBOL = np.isin(_BYTES, list(SYMBOLS.encode()))
_IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_IS_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_IS_MARK = np.isin(_BYTES, list(b"!?"))
_STARTS = (_BYTES < 128) | (_BYTES >= 192)


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found twice or more."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The values of ``_COUNTS`` for one whole text."""
    words = ascii_words(text)
    histogram = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    hashes = word_hashes(words)
    lines = [line for line in text.split("\n") if line.encode("utf-8", "surrogatepass").split()]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return (len(words), int(histogram[_STARTS].sum() - histogram[_IS_SPACE].sum()), int(histogram[_IS_SYMBOL].sum()),
            len(lines) - len(set(lines)), repeated_words(hashes), len(lines), len(np.unique(hashes)), int(histogram[_IS_UPPER].sum()),
            int(histogram[_IS_DIGIT].sum()), int(histogram[_IS_MARK].sum()), int((sizes <= 3).sum()), int(sizes.max(initial=0)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tags, at = batch.column(2).to_pylist(), 0
        for ids, texts in text_chunks(iter([batch])):
            values = np.array([text_counts(t) for t in texts], dtype=np.int64).reshape(len(texts), len(_COUNTS))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(tags[at:at + len(ids)], pa.int64()), *(pa.array(values[:, i]) for i in range(len(_COUNTS)))],
                                  ["doc_id", "tag", *_COUNTS])
            at += len(ids)
    release_memory()


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tag (hash of the text) and the counts of every whole text."""
    rows = id_and_text(docs, key, text)
    schema = "doc_id long, tag long, " + ", ".join(f"{c} long" for c in _COUNTS)
    return rows.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(_counted, schema)


def _count_structs(texts: list[str | None]) -> pa.Array:
    values = np.array([text_counts(t or "") for t in texts], dtype=np.int64).reshape(len(texts), len(_COUNTS))
    return pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(_COUNTS))], list(_COUNTS))


def features(inside: str = "") -> dict[str, Column]:
    """The statistics that thresholds are put on; shares of an empty text are 0.  ``inside``: a struct's name and a dot."""
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(inside + a), F.col(inside + b)), F.lit(0.0)).cast("double")
    return {
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
        "line_words": share("n_words", "n_lines"), "distinct_share": share("n_distinct_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "n_words"), "short_share": share("n_short_words", "n_words"),
        "words": F.col(f"{inside}n_words").cast("double"), "longest": F.col(f"{inside}longest_word").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        values = columns[self.feature]
        return values >= self.threshold if self.at_least else values <= self.threshold

    def expression(self, columns: dict[str, Column]) -> Column:
        values = columns[self.feature]
        return values >= F.lit(self.threshold) if self.at_least else values <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, columns: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    for condition in rule:
        out &= condition.holds(columns)
    return out


def _best_condition(columns: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Condition | None:
    """The threshold with the highest information gain over the covered rows (FOIL's measure)."""
    index = np.flatnonzero(rows)
    total, hits = len(index), int(bad[index].sum())
    if not hits or hits == total:
        return None
    base, best, found = np.log2(hits / total), 1e-9, None
    for name, values in columns.items():
        order = index[np.argsort(values[index], kind="stable")]
        ordered, marks = values[order], bad[order].astype(np.int64)
        cut = np.flatnonzero(ordered[1:] > ordered[:-1])
        if not len(cut):
            continue
        low_hits, low_all = np.cumsum(marks)[cut], cut + 1
        for at_least, p, n in ((False, low_hits, low_all), (True, hits - low_hits, total - low_all)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p >= MIN_COVER, p * (np.log2(p / n) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                middle = float((ordered[cut[k]] + ordered[cut[k] + 1]) / 2)
                best, found = float(gain[k]), Condition(name, at_least, middle)
    return found


def _precision(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, int]:
    covered = _covers(rule, columns, rows)
    n = int(covered.sum())
    return (float(bad[covered].sum() + 1) / (n + 2), int(bad[covered].sum()))


def learn_rules(columns: dict[str, np.ndarray], bad: np.ndarray, marks: np.ndarray) -> list[Rule]:
    """Ordered conjunctions that cover low-quality rows; ``marks`` (any integers per row) part growing from pruning rows."""
    grow_rows, prune_rows = marks % 3 != 0, marks % 3 == 0
    left, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        covered = left & grow_rows
        while len(rule) < MAX_CONDITIONS and (condition := _best_condition(columns, bad, covered)) is not None:
            rule, covered = (*rule, condition), covered & condition.holds(columns)
        if not rule:
            break
        # Prune: the shortest beginning of the rule that is as precise on the other rows as any longer one.
        scores = [_precision(rule[:k], columns, bad, left & prune_rows) for k in range(1, len(rule) + 1)]
        k = max(range(len(scores)), key=lambda i: (round(scores[i][0], 3), scores[i][1], -i))
        rule = rule[:k + 1]
        if scores[k][1] < 2 or scores[k][0] < min(MIN_PRECISION, (scores[k][1] + 1) / (scores[k][1] + 2)):
            break
        rules.append(rule)
        left &= ~_covers(rule, columns, left)
    return rules


def verdict(rules: list[Rule], inside: str = "") -> Column:
    """Ordered CASE WHEN: the first rule that holds rejects; what no rule covers is kept."""
    columns, out = features(inside), None
    for rule in rules:
        condition = F.lit(True)
        for part in rule:
            condition = condition & part.expression(columns)
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(statistics: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> list[Rule]:
    """The decision list from at most ``bound`` labelled rows (quality 0: reject)."""
    marked = (labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min("quality").cast("int").alias("quality")))
    rows = statistics.join(marked, "doc_id").select("doc_id", *(c.alias(n) for n, c in features().items()), "quality")
    with Scratch() as tables:
        sample = bounded_sample(tables.keep(rows), "doc_id", bound).toArrow().sort_by("doc_id")
    columns = {n: sample.column(n).to_numpy() for n in features()}
    bad = sample.column("quality").to_numpy() == 0
    return learn_rules(columns, bad, sample.column("doc_id").to_numpy())


def base_failed(inside: str = "") -> Column:
    words, repeats = F.col(f"{inside}n_words"), F.col(f"{inside}n_repeat_words")
    return (words < 10) | (F.lit(100) * repeats > F.lit(20) * words)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, tag, the counts, base_failed and kept."""
    statistics = reliable_checkpoint(text_statistics(docs, key, text))
    rules = fit(statistics, labels)
    return statistics.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rules and the learned list; the list is learned from labelled rows of ``docs``."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("known")).distinct()
    with Scratch() as tables:
        # Ids first: texts are counted for the sample alone.
        ids = tables.keep(docs.select(F.col(key).cast("long").alias("known")).join(known, "known").distinct())
        chosen = tables.keep(bounded_sample(ids, "known", MAX_LABELLED))
        labelled = docs.join(F.broadcast(chosen), docs[key].cast("long") == chosen["known"], "left_semi")
        rules = fit(text_statistics(labelled, key, text), labels)
    kind = "struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">"
    counted = map_texts(docs, text, lambda: _count_structs, kind, pa.struct([(c, pa.int64()) for c in _COUNTS]))
    return counted.where(~base_failed("out.") & verdict(rules, "out.")).select("row.*")
