import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and repeated texts, repeated rows and a very long text."""
    word = "The quick brown fox jumps over the lazy dog. "
    rows = [
        (1, "Hello world, hello again.", "en", "a", 1),
        (2, "Hello world, hello again.", "en", "b", 1),
        (2, "Hello world, hello again.", "en", "b", 1),
        (3, "", None, None, None),
        (4, None, "en", "a", None),
        (None, "A text whose id is null.", "en", None, 1),
        (5, word * 3000, "en", "a", 1),
        (6, word * 3000 + "end", "en", "a", 1),
        (7, "x" * 200_000, "de", "c", 1),
        (8, "\n \t\r\n", "fr", "c", 1),
        (9, "日本語 🎉 ÄÖÜ é́", "fr", "c", 1),
        (10, "!!! ??? ...", "de", "c", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """The same with columns whose names might clash with an operator's own."""
    from pyspark.sql import functions as F

    names = ["word", "code", "n", "fp", "key", "hash", "rank", "position", "score", "size", "block", "slot", "kept", "root", "print", "license", "dice", "w", "t", "h", "none", "stop"]
    return docs.withColumns({c: F.lit(c) for c in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
