import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
#: doc_id, text: nulls, empty and blank texts, repeated rows, ties, a very long text, one long word, odd white space.
EDGES = [
    (None, "a text without an id but with words enough to count as one"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "x" * 5000),
    (7, LONG), (8, "é ü 漢字 😀 \u00a0 \u2003 tail"), (9, "ONE two\x0bthree\x0cfour five six"), (10, "one TWO three four five six"), (11, "<|endoftext|> it's 'll 123"), (None, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge cases as a table whose other columns clash with names of results."""
    rows = [(i, t, "en", "src", 7, 0.5, True, 3, "rows", 1) for i, t in EDGES]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard int, law string, length long")
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
