import pytest

from sondage.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", "tests")
    yield session
    session.stop()
