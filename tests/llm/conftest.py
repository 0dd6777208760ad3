import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
#: texts that every operator must take: null, empty, blank, one word, symbols, very long, repeated
ODD_TEXTS = [None, "", " \n\t ", "a", "### $$$ 123", LONG, "the same text twice", "the same text twice", "ünï çödé 漢字 😀\x00 tail"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with null keys, repeated rows and columns named like results."""
    rows = [(None if i == 3 else i, t, "en" if i % 2 else None, "s", None, "clash", 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], rows[6]]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string, labels int"
    ).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
