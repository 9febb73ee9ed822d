import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept boolean, size int, id long, cid long, grp int, w string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to documents with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 7, False, 3, 1, 2, 3, "w") for i, t, s in (r if len(r) == 3 else (*r, "a") for r in rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))

#: Null and empty texts, null ids, repeated rows, ties, white space alone, a long text, invalid-looking characters.
EDGES = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "one two three four five six seven eight nine ten eleven", "b"), (4, "word", "b"), (5, "word", "b"), (5, "word", "b"), (6, LONG, None), (7, LONG, None),
    (8, "naïve café 漢字 \x00 \x85   👍🏽", "c"), (9, "A line\nA line\nA line\n\n", "c"),
]


@pytest.fixture(scope="session")
def edges(documents):
    return documents(EDGES)


@pytest.fixture(scope="session")
def nothing(documents, spark):
    from tests.llm.conftest import SCHEMA

    return spark.createDataFrame([], SCHEMA)
