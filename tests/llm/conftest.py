import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, items string, size string, kind string"
#: Null ids, texts and labels, empty and long texts, repeated rows, and columns named like those the operators make.
ROWS = [
    (0, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, "Is and the of to be. The cat; the dog!\nIt is.", "en", "a", 5),
    (2, "Is and the of to be. The cat; the dog!\nIt is.", "en", "a", 5),
    (3, "die und das ist ein großer Baum, der nicht fällt", "de", "b", 9),
    (4, "   \n\t ", None, "b", 3),
    (5, "x", "en", None, 1),
    (None, "no id here at all", "en", "c", 1),
    (6, "word " * 3000 + "Ä" * 3000, "de", "c", 1),
    (7, "12345 !!! ... ###", "en", "c", 1),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, "r", "i", "s", "k") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """A table of the smallest set of test data."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
