import pytest

from fleetlens.llm.queries import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
