import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def words(start, n, step=1):
    """``n`` words that other ranges of numbers do not share."""
    return " ".join(f"w{k}x" for k in range(start, start + n * step, step))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from ``(doc_id, text, source)``, with extra columns if asked for."""

    def make(rows, extra=()):
        data = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(data, DOCS)
        for name in extra:
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null ids, texts and sources, empty and wordless and long texts, ties and repeated rows."""
    base = words(0, 60)
    line = words(5000, 55)
    return [
        (1, base, "a"), (2, base, "a"), (3, base.replace("w30x", "changed"), "b"), (4, None, "a"), (5, "", None), (6, " \t\n ", "b"),
        (7, "Two words", "a"), (8, "two WORDS", None), (None, base, "a"), (None, None, None), (9, words(1000, 4), "b"),
        (10, f"{line}\n{words(7000, 10)}", "a"), (11, f"{words(8000, 10)}\n\n{line}\n\ntail", "a"), (12, line, "c"),
        (13, words(100_000, 30_000), "c"), (14, f"{words(9000, 5)}\n{line}", "b"), (14, f"{words(9000, 5)}\n{line}", "b"),
        (15, "ñandú Straße 日本語 😀 ▁ x", "b"), (16, "mail me at a.b@c.de or +1 (123) 555-1234", "a"),
    ]
