import pytest

EXTRA = "fp string, score string, root long, key string, sequence_id string, part string, line string, removed string, toxic string, nth string, kept_doc string, surplus string"


@pytest.fixture(scope="session")
def docs_frame(spark):
    """docs_frame(rows) -> documents of (doc_id, text), with further columns named like the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or "")) + (None,) * 12 for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)

    return make


LONG = "The quick brown fox jumps over the lazy dog while Zebras don't care. " * 3000
EDGE = [
    (1, "one two three four"), (2, None), (3, ""), (4, " \n\t "), (None, "no id here at all"), (5, LONG), (6, "\x1c odd \x85 space\xa0"),
    (7, "one two three four"), (7, "one two three four"), (8, "<|endoftext|> naïve ÉCOLE 漢字 🙂"), (9, "x" * 30_000), (10, "\n\n\n"),
]


@pytest.fixture(scope="session")
def edge(docs_frame):
    return docs_frame(EDGE)


@pytest.fixture(scope="session")
def empty(docs_frame):
    return docs_frame([])
