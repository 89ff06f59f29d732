import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """A folder with a documents table of (doc_id, text, lang, source) rows."""

    def build(rows):
        folder = str(tmp_path_factory.mktemp("tables"))
        full = [(d, t, lang, source, None if t is None else len(t)) for d, t, lang, source in rows]
        spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
        return folder

    return build


#: Nulls everywhere, empty and blank texts, repeated rows and texts, no words but symbols, other white space, non-ASCII.
HARD = [
    (1, None, None, None), (None, "no id here", "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "en", None), (4, "same text " * 30, "en", "a"), (5, "same text " * 30, "en", "b"), (5, "same text " * 30, "en", "b"),
    (6, "###", "de", "b"), (7, "Ünï cödé — ж\u00a0x\u2003y", None, "b"), (-8, "UPPER lower\nUPPER lower\n\nUPPER lower", "en", "a"), (9, "x" * 5000, "en", "a"), (10, "a b c", "fr", "\U0001f600"),
    (11, " ".join(f"w{i}" for i in range(4000)), "en", "a"), (12, "a", "en", "Z"),
]


@pytest.fixture(scope="session")
def hard(make):
    return make(HARD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
