"""Top-k tables by hash and second read, and typing by row counts."""

import random
from collections import Counter

import pytest

from colscope.operators import frequencies as freq
from colscope.operators import semtypes

LONG = "https://example.org/a/long/common/beginning/"


def brute(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda t: (-t[1], t[0].encode()))[:k]


def columns():
    rng = random.Random(4)
    n = 240
    return {
        "unique_long": [f"{LONG}{k:05d}" for k in rng.sample(range(n * 9), n)],
        "pairs_long": [f"{LONG}{k // 2:05d}" for k in range(n)],
        "mixed_long": [f"{LONG}{rng.choice([1, 1, 1, 2, 2, 3, rng.randrange(400)]):05d}" for _ in range(n)],
        "half_twice": [f"{LONG}{k // 2 if k < n // 2 else k:05d}" for k in range(n)],
        "short": [rng.choice("abcdefgh") for _ in range(n)],
        "twelve": [f"{k % 30:012d}" for k in range(n)],
        "odd": [rng.choice([None, "", "é" * 40, "é" * 39 + "z", "\U0001f600" * 13, "z" * 5000, " "]) for _ in range(n)],
        "none": [None] * n,
        "few": [LONG + "x" if k < 2 else LONG + "y" if k < 4 else None for k in range(n)],
    }


@pytest.mark.parametrize("k, broadcast", [(5, 1_000_000), (3, 0), (8, 1_000_000)])
def test_top_values(spark, monkeypatch, k, broadcast):
    monkeypatch.setattr(freq, "BROADCAST_HASHES", broadcast)
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} string" for c in data))
    tops, distinct, valid = freq.frequency_summary(df, list(data), k)
    for c, values in data.items():
        assert tops[c] == brute(values, k), c
        assert distinct[c] == len(set(values) - {None}) and valid[c] == sum(v is not None for v in values)
    rows = freq.top_k_frame(df, ["pairs_long", "short"], k, ascending=True).collect()
    assert [r.value for r in rows if r.variable == "short"] == [v for v, _ in brute(data["short"], k)][::-1]
    assert freq.frequency_summary(df.limit(0), list(data), k)[0] == {c: [] for c in data}


def test_no_text_in_a_shuffle(spark):
    """The exchange of the count table carries numbers and at most PREFIX characters."""
    df = spark.createDataFrame([(LONG,)], "t string")
    plan = freq.hashed_counts(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "value" not in exchange and "pre#" in exchange


def test_typing_needs_one_row_a_task(spark):
    rows = [(f"2024-01-{k % 28 + 1:02d}", "12 monkeys" if k % 3 else "12/31/2020", None if k % 2 else "2020-13-45", "x" * 100) for k in range(60)]
    df = spark.createDataFrame(rows, "day string, mixed string, wrong string, text string")
    assert semtypes.semantic_types(df) == [("day", semtypes.TEMPORAL), ("mixed", semtypes.CATEGORICAL), ("wrong", semtypes.CATEGORICAL), ("text", semtypes.CATEGORICAL)]
    counts = semtypes.parse_counts(df, df.columns)
    assert counts["day"][:2] == [60, 60] and counts["mixed"][0] == 60 and max(counts["mixed"][1:]) == 20 and counts["wrong"] == [30] + [0] * 10
    assert semtypes.parse_counts(df.limit(0), ["day"]) == {"day": [0] * 11}
