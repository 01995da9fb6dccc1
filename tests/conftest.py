import pytest

from palimpsest.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples."""

    def get(df, *columns):
        data = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(data, key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float)) else (True, "n", x) for x in r))

    return get
