import pytest

from tests.oracle import session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples, in column order."""
    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is None, str(type(v)), v) for v in t))
    return collect
