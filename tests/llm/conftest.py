import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ("h", "t", "p", "size", "cands", "component", "component_id", "blocks", "id", "k", "__id", "copies", "digest", "seq", "pattern")


def with_clashes(df):
    from pyspark.sql import functions as F

    for c in CLASHING:
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows and clashing columns."""
    words = "The quick brown fox jumps over the lazy dog near the old river bank today".split()
    long = " ".join(words[(i * i + i // 7) % len(words)] + str(i % 97) for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "The Quick brown fox jumps over the lazy dog", "en", None, None),
        (3, None, None, None, None), (4, "", "en", "b", 0), (5, "  \t\n ", "en", "b", 4), (None, "a text without an id at all here", "en", "b", 30), (None, None, None, None, None),
        (6, "short", "en", "c", 5), (7, long, "en", "c", len(long)), (8, long + " tail", "en", "c", len(long) + 5), (9, "Été 中文 \U0001f600 naïve café words here", "fr", "\U0001f600", 20),
    ]
    return with_clashes(spark.createDataFrame(rows, DOCS))


@pytest.fixture(scope="session")
def nothing(spark):
    return with_clashes(spark.createDataFrame([], DOCS))
