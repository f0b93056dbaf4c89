import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, memory="4g")
