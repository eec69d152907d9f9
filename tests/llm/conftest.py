import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("id", T.StringType()), T.StructField("_text", T.StringType()), T.StructField("t", T.LongType()),
    T.StructField("positions", T.LongType()), T.StructField("clean_text", T.StringType()), T.StructField("pos", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with extra columns of clashing names."""

    def make(pairs):
        rows = [(i, t, "en", "src0", None if t is None else len(t), "x", "y", 1, 2, "z", 3) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


ODD_TEXTS = [
    "", " ", "\n", "a", "one two three", "one two three four five six seven eight nine ten.\n" * 4, "word " * 5000,
    "x" * 20_000, "Überraschung ça va? İstanbul ΣΑΣ 漢字 ไทย 🎉", "<|endoftext|> and <s> text </s> <unk>", "tab\there\r\nline\x0bvt\x0cff",
    "don't IT'S 'tis 1,234.5 — “quoted” ▁ mark", "The same line stands here.\nThe same line stands here.\nAnother one.",
]


@pytest.fixture(scope="session")
def odd_pairs():
    """Odd texts: null, empty, very long, repeated rows, ties, a null id."""
    pairs = [(i, t) for i, t in enumerate([None, *ODD_TEXTS])]
    return [*pairs, pairs[5], pairs[5], (100, pairs[6][1]), (None, pairs[6][1]), (None, None)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
