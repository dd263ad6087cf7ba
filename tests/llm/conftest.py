import pytest

# Rows with nulls, blanks, repeats, ties, one very long word and columns that operators use as names themselves.
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \t\n\x0b\x0c\r ", "de", "b"),
    (None, "a text without an id that nobody can name at all", "en", "c"),
    (None, None, None, None),
    (6, LONG, "en", "a"),
    (7, "x" * 50_000, "en", "a"),
    (8, "Mail bob@example.org or +1 (504) 555-2652, card 4111 1111 1111 1111, host 10.0.0.1 Übung ΑΣ <|endoftext|>", "de", "b"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """ROWS with extra columns whose names clash with those that operators add."""
    return spark.createDataFrame([(*r, 1, "s", 2.5, True, [1], 7) for r in ROWS], SCHEMA + ", shard int, slot string, kept double, row boolean, body array<int>, part int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (8, 1, 1)], "doc_id bigint, quality int, toxic int")
