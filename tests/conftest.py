import pytest

from nearpass.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", **{"spark.driver.memory": "4g"})
    yield s
    s.stop()
