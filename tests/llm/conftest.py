import pytest
from pyspark.sql import types as T
from texts import prose

#: Names that the operators use inside; documents may have them too.
CLASHING = ["row", "tag", "counts", "clean", "kept", "n_words", "length", "size", "task", "rank", "value", "spans", "shard", "slot", "own_id", "h", "w", "r"]

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])


@pytest.fixture(scope="session")
def table(spark):
    """(id, text) pairs as a documents table with clashing extra columns, all NULL or 'x'."""
    def build(rows):
        return spark.createDataFrame([(i, t, None, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in rows], SCHEMA)
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty, one word, blanks, repeated rows, one text under two ids, a very long text, a text beyond Latin-1."""
    long = prose(1, 60_000)
    return [(1, None), (2, ""), (3, "word"), (4, " \n\t \n"), (None, prose(2, 30)), (5, prose(3, 40)), (5, prose(3, 40)), (6, prose(3, 40)),
            (7, long), (8, "naïve café — 東京 \U0001f600 <|endoftext|> 'll it's  12x y\n\n z"), (9, prose(4, 25) + "\n" + prose(5, 25)), (-4, prose(6, 300))]
