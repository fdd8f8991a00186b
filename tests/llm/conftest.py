import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, other alphabets, clashing extra column."""
    long = " ".join(f"word{i % 997} idiot" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon.\nThe second line.", "en", "a", 5, "x"),
        (1, "Alpha beta gamma delta epsilon.\nThe second line.", "en", "a", 5, "x"),
        (2, None, "en", "a", None, None),
        (3, "", "fr", "b", 0, "x"),
        (4, long, "en", None, 1, "x"),
        (5, "你好 мир ΣΑΣ    ﬁn 𝒳", None, "b", 1, "x"),
        (None, "no id here <|endoftext|> x", "fr", "c", 1, "x"),
        (7, "!!! ... 123", "en", "a", 1, "x"),
        (8, "Alpha beta gamma delta epsilon.\nThe second line", "en", "d", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS).withColumnsRenamed({"extra": "score"})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (4, 0, 1), (None, 1, 1), (3, None, None), (8, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
