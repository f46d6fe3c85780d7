import pytest

from lodestone.sources.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, driver_memory="4g")
