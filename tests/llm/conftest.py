import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ties, and columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    line = "A line that several documents have."
    rows = [
        (1, None, None, None, None), (2, "", "en", "b", 0), (3, "   \t\n\x0b ", "en", "b", 5), (4, long, "en", "a", 1), (5, long + " more", "en", "a", 1), (6, f"one\n{line}\ntwo", "en", None, 3),
        (7, f"one\n  {line.upper()}\nthree", "en", "b", 3), (8, line, "en", "b", 3), (8, line, "en", "b", 3), (None, f"{line}\nfour", "en", "b", 3), (9, "a b c a b c a b c", "de", "c", 9), (10, "é ü\r\nñ", "fr", "c", 5),
        (11, "x", "en", "a", 1), (11, "a different text with the same id as the other row has", "en", "a", 1),
    ]
    names = ["rest", "rank", "size", "w", "v", "key", "n", "shard", "row", "label", "source_size"]
    frame = spark.createDataFrame(rows, DOCS)
    for name in names:
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
