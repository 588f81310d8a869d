import pytest
from llm_tables import tables, write


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    return write(tmp_path_factory.mktemp("edge"), tables())


@pytest.fixture(scope="session")
def clash(tmp_path_factory):
    return write(tmp_path_factory.mktemp("clash"), tables(), extra=True)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), {})
