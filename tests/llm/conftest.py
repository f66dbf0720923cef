import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and a column of a clashing name."""
    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "x y z"), (4, "long words " * 20_000), (5, "😀 é ퟿ z"), (6, "one")]
    return spark.createDataFrame([(k, t, "en", "s", 0, 9) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
