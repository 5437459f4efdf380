import pytest

CLASHING = ("doc_id long, text string, lang string, source string, n_chars long, `Score` int, `_code` int, `_row` string,"
            " `hits` int, `_hits` int, `keep_id` int, fingerprint int, part int, label int, features int")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents (doc_id, text) with the other columns of the table and columns whose names clash."""

    def make(texts, ids=None, lang=None, source=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang[k] if lang else "en", source[k] if source else "s", len(t or ""), 1, 2, "r", 3, 4, 5, 6, 7, 8, 9)
                for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, CLASHING)

    return make


@pytest.fixture()
def rough(documents):
    """NULL and empty texts, NULL and repeated ids, repeated rows, one very long text."""
    long = " ".join(f"word{i % 977}" for i in range(60000))
    return documents([None, "", "a b c", "a b c", "a b c", long, "x", None, " \n\t "], [1, 2, 3, 3, None, 4, None, None, 5])
