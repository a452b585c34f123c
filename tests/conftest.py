import pytest

from lorewell.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/lorewell-warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
