import pytest

from .support import session


@pytest.fixture(scope="session")
def spark():
    return session()
