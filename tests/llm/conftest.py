import pytest

from foliant.llm.runtime import ship


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


#: Awkward rows that every operator on documents takes: null and empty texts, blank ones, a null
#: id, a long text, repeated rows, and words of several scripts.
ODD = [
    (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (None, "a null id has a text", "x"), (4, "one", "x"), (5, "word " * 5000, None), (6, "Same text of two rows here", "x"), (6, "Same text of two rows here", "x"),
    (7, "漢字   ÀÉ 👍 #$%", "x"), (8, "Same text of two rows here", "y"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Extra columns carry names that operators use inside."""
    rows = [(i, t, x, 1, 2.0, "b") for i, t, x in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block int, row double, bucket string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
