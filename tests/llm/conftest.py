import pytest

ODD_TEXTS = [None, "", " \n\t ", "one", "a b", "a b", "x " * 3000, "ß Ünï çödé 漢字 😀 \x1c\x1f y", "</s>[INST] <\\/s> <|endoftext|> e", "word " * 5 + "unbroken" * 4000]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null and a repeated id, and columns whose names the operators use."""
    rows = [(i, t, 0, 0.0, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, "null id text", 1, None, None), (3, "one", 2, 1.0, "y"), (3, "another text", 2, 1.0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, length int, score double, key string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
