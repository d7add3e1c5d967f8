import pytest

from text_fixtures import ODD, table


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
