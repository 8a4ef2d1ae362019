import pytest

#: Nulls, empty and letterless texts, ties, repeated rows, near copies and a long text.
LONG = "".join(f"word{i} " for i in range(60_000))
BASE = " ".join(f"w{i}" for i in range(80))
ROWS = [
    (1, "the cat sat on the mat and the dog ran home.", "en", "a"),
    (2, "the cat sat on  the mat\tand the dog ran home.", "en", "a"),
    (2, "the cat sat on  the mat\tand the dog ran home.", "en", "a"),
    (3, None, "en", None), (4, "", None, "b"), (5, " \t\n", "de", "b"), (6, "123 456", "de", "b"), (None, "ein Text ohne Nummer", "de", None),
    (7, LONG, "en", "c"), (8, BASE, "fr", "c"), (9, BASE.replace("w40 ", "changed "), "fr", "c"), (10, BASE, "fr", "c"),
    (11, "x" * 3000, None, "d"), (12, "über den Fluß 文字 😀", "de", "d"), (13, f"kopf zeile\n{BASE} eins zwei\nfuß", "fr", "a"), (14, f"andere zeile\n{BASE} eins zwei\nende", "fr", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, tricky):
    """The same rows with further columns, named like those that operators make."""
    from pyspark.sql import functions as F

    names = "id n h sig token df rep root kept keep_id size target taken shard slot law lang_pred score n_tokens spans rank __h __id __n __c0 __lang_pred a.b".split()
    return tricky.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
