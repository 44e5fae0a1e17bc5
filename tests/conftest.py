import pytest

from tests.oracle import DATA, connect, make_spark


@pytest.fixture(scope="session")
def spark():
    return make_spark()


@pytest.fixture(scope="session")
def folder():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(folder):
    return connect(folder)
