import pytest

# Columns whose names an operator might use for itself.
CLASHES = ["id", "key", "row", "site", "hash", "n", "at", "start", "length", "shard", "slot", "salt", "node", "number", "statistics", "n_lines", "spans", "words", "segment", "version"]

WORDS = "the river bends north past old mills where quiet boats carry grain and salt to market each early morning while birds follow them down slowly".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties and repeated rows, clashing names."""
    long = " ".join(WORDS[i % len(WORDS)] + str(i % 977) for i in range(60_000))
    rows = [
        (1, "plain words here\nshared line of several words", "en", "a"),
        (1, "plain words here\nshared line of several words", "en", "a"),
        (2, None, None, None),
        (None, "a text without an id\nshared line of several words", "en", "b"),
        (None, None, None, None),
        (3, "", "en", "c"),
        (4, " \n\t \n", "en", "c"),
        (5, long, "en", "d"),
        (6, long, "en", "d"),
        (7, "Ünïcode 漢字 😀 text\r\nwith\x0bodd\x0cblanks   end", "xx", "e"),
        (8, "word", "en", "e"),
        (9, "word", "en", None),
        (9, "another text under the same id", "en", "f"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for name in CLASHES:
        docs = docs.selectExpr("*", f"'x' AS {name}")
    return docs


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
