import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"


@pytest.fixture
def documents(spark):
    """Rows with clashing extra columns from texts; doc_id is the place."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", None if t is None else len(t), "k", "r") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return make


EDGE = [None, "", " \n\t ", "one", "two words", "a b c d e f g " * 3000, "same line\nsame line\nother", "same line\nsame line\nother", "é漢字 🙂 ß"]


@pytest.fixture
def edge(documents):
    return documents(EDGE)
