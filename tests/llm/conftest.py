import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("id", T.StringType())])


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(3)
    syllables = ["ta", "ri", "on", "the", "mu", "lo", "éa", "ßu", "ke"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 90))) for _ in range(30)]
    texts += [None, None, "", "   ", "One", "two words", "😀 emoji text".encode("utf-16", "surrogatepass").decode("utf-16"), "x " * 5000, texts[0], texts[0], texts[0], texts[1] + " end", texts[2].replace(" ", "  ", 1), texts[3].upper()]
    out = [(i * 3 % 100, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None, "c"]), len(t or ""), "clash", "x") for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, texts[5], None, None, None, None, None), (77, "lone null source", None, None, 16, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
