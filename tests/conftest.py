import pytest

from meshline.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted rows of a DataFrame as tuples, for comparing whole results."""

    def of(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return of


def frame(spark, header: str, *lines: tuple):
    """A table of strings with the file's order, as a feed gives it."""
    names = header.split()
    schema = ", ".join(f"{n} string" for n in names) + ", _ordinal long"
    return spark.createDataFrame([(*line, i) for i, line in enumerate(lines)], schema)


@pytest.fixture(scope="session")
def feed(spark):
    return lambda header, *lines: frame(spark, header, *lines)
