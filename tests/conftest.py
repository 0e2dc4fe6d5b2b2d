import pytest

from glyphflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "glyphflow-tests")
    yield session
    session.stop()
