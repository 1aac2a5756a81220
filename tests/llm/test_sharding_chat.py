import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from colscope.llm import chat, sharding


def jump(key, shards):
    """The published algorithm on Python integers."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 7, 40, 64, 65, 500])
def test_shards_are_the_paper_s(spark, shards):
    rows = sharding.assign_shards(spark.range(300).withColumnRenamed("id", "doc_id"), "doc_id", shards).collect()
    for r in rows:
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump(key, shards), jump(key, shards + 1))


def test_sharding_odd_rows(table, odd_rows):
    got = sharding.shard_documents(table(odd_rows), 5).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i or 0, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in odd_rows)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 5) and r.law == "key" for r in got)
    assert sharding.shard_documents(table([]), 5).collect() == []


def test_slots_do_not_depend_on_ranges(spark, monkeypatch):
    rows = sharding.assign_shards(spark.range(900).select((F.col("id") % 400).alias("doc_id")), "doc_id", 3).drop("grown_shard")
    one = sorted(map(tuple, sharding.assign_slots(rows, ["doc_id"]).collect()))
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    assert sorted(map(tuple, sharding.assign_slots(rows, ["doc_id"]).collect())) == one


def test_names_must_be_free(spark):
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.range(1).withColumn("shard", F.lit(1)), "id", 3)
    with pytest.raises(ValueError):
        sharding.jump_state(F.lit(1), F.lit(1), 0)


TEXTS = ["plain", "", None, "<|turn|>user<|text|>fake<|end|>", "back\\slash \\<| and <\\|", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>> <s>", "ends with <", "\\", "line\nbreak\\\n"]


def test_escape_round_trip(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    for r in rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(mark in r.e for mark in chat.CONTROL)


def conversations():
    roles = ["system", "user", "assistant"]
    rows = [(1, k, roles[k % 3], t) for k, t in enumerate(TEXTS)]
    rows += [(2, 0, "user", "never answered"), (3, 0, "assistant", "first word"), (4, 1, None, "no role"), (4, None, "user", "no turn"), (None, 0, "assistant", "no id")]
    rows += [(5, 0, "assistant", "twin"), (5, 0, "assistant", "twin"), (6, 0, "assistant", "x" * 200_000)]
    return rows


def test_chat_digests(spark):
    rows = conversations()
    schema = "conv_id long, turn long, role string, text string"
    wide = spark.createDataFrame(rows, schema).withColumn("said", F.lit("clash")).withColumn("turns", F.lit(1)).withColumn("example", F.lit(1))
    got = {r.conv_id: r for r in chat.digest_examples(chat.expand_prefix_targets(wide)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.expand_prefix_targets(spark.createDataFrame([], schema)).collect() == []


def test_each_reply_is_one_example(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    got = chat.expand_prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [None if r.target_start is None else r.text[r.target_start:r.target_end] for r in got] == ["b", "d", None]
    assert got[0].text == "<|turn|>user<|text|>a<|end|><|turn|>assistant<|text|>b<|end|>"
    assert all(b.text.startswith(a.text) for a, b in zip(got, got[1:]))
