import pytest

from tests.spark_session import session


@pytest.fixture(scope="session")
def spark():
    return session(4, 4)
