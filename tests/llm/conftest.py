import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def vocab():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(4000)]


@pytest.fixture(scope="session")
def make_docs(spark):
    from threadlens.session import ship_package

    ship_package(spark)

    def make(texts, ids=None, langs=None):
        """Documents with extra columns named like the operators' own ones."""
        rows = [(i if ids is None else ids[i], t, None if langs is None else langs[i], f"s{i % 3}",
                 None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOC)
        from pyspark.sql import functions as F
        clash = ("row", "key", "n", "words", "component", "component_id", "kept", "_text", "_h", "times", "list",
                 "rate", "line", "a", "b", "anchor", "score", "n_words")
        return df.select("*", *(F.lit(7).alias(c) for c in clash))

    return make


@pytest.fixture(scope="session")
def edge_texts(vocab):
    """Null, empty, blank, one word, exact repeats, a very long text, wide characters, odd white space."""
    rng = random.Random(9)
    body = prose(rng, 120, vocab)
    return [None, "", " \t\n\x0b\f\r ", "word", "word", body, body, "é ü ñ 語 \U0001f600 x", "12 34 !!",
            prose(rng, 30_000, vocab), "a b c", "A B C", body.upper()]
