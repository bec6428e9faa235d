import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, salt=""):
    """``n`` different words."""
    return " ".join(f"w{salt}{i}" for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and blank texts, copies, repeated rows and a long text."""
    long = words(20_000, "long")
    rows = [
        (1, words(60, "a"), "en", "s", None),
        (2, words(60, "a"), "en", None, 3),
        (2, words(60, "a"), "en", None, 3),
        (3, None, "en", "s", 0),
        (4, "", "en", "s", 0),
        (5, " \t\n\x0b\x0c\r ", None, "s", 7),
        (None, "lone words here", "en", "s", 1),
        (None, None, None, None, None),
        (6, long, "de", "s", len(long)),
        (7, "é İ ß́ <|endoftext|> don't  stop\n\n### 中文 🙂 x", "fr", "s", 9),
        (8, words(60, "a") + "\n" + words(60, "b") + ".", "en", "s", 1),
        (9, "one", "en", "s", 3),
    ]
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd documents with columns of names that operators use themselves."""
    extra = ["_id", "_text", "label", "size", "shard", "TEXT", "uid", "hub", "words", "kept", "ids", "a.b", "path", "_key", "ranges", "host"]
    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
