import pytest

from factloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session("local[8]", 8, spark__ui__enabled="false", spark__driver__memory="6g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__ui__showConsoleProgress="false")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
