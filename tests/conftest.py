import pytest


@pytest.fixture(scope="session")
def spark():
    from tests.session import local_session

    return local_session()
