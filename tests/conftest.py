import pytest

from estatelens import session


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
    })
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples of the named columns."""

    def get(df, *names):
        return sorted((tuple(r) for r in df.select(*names).collect()), key=str)

    return get
