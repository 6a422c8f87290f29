import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, n_words string"

PROSE = (
    "The river runs past the old mill and turns west below the bridge.\n"
    "Farmers meet there on market days, when carts fill the narrow road from the hills.\n"
    "In winter the water rises and the lower fields stay wet until spring comes again."
)


def rows_of(*texts, first=0):
    return [(i, t, "en", "s", None, 7, "x") for i, t in enumerate(texts, first)]


@pytest.fixture(scope="session")
def docs(spark):
    """``docs(rows)``: documents with extra columns whose names clash with the operators' own."""
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and blank texts, a repeated row, a shared id, a long text."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000)) + "."
    rows = [
        (None, PROSE, None, None, None, None, None),
        (None, None, None, None, None, None, None),
        (1, None, "en", "s", 0, 1, "a"),
        (2, "", "en", "s", 0, 1, "a"),
        (3, " \t\n\n ", "en", "s", 5, 1, "a"),
        (4, PROSE, "en", "s", 1, 1, "a"),
        (4, PROSE, "en", "s", 1, 1, "a"),
        (4, PROSE + "\nOne more line for the second text of this id.", "en", "s", 1, 1, "a"),
        (5, long, "en", "s", 1, 1, "a"),
        (6, "héllo wörld \U0001f600 <|endoftext|> 'S x's", "en", "s", 1, 1, "a"),
    ]
    return docs(rows)


@pytest.fixture(scope="session")
def none(docs):
    return docs([])
