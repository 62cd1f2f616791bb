import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs(spark):
    """Documents from texts; languages and sources cycle, with nulls among them."""

    def make(texts, ids=None):
        rows = []
        for k, text in enumerate(texts):
            rows.append((ids[k] if ids else k, text, ("en", "de", None)[k % 3], ("a", "b", None, "c")[k % 4], len(text or "")))
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    """Seeded prose."""
    import random

    rng = random.Random(5)
    stock = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n, seed):
        pick = random.Random(seed)
        return " ".join(pick.choice(stock) for _ in range(n))

    return prose
