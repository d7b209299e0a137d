import pytest

from vitalgrain.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", 4)
    yield session
    session.stop()
