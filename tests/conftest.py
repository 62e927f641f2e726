import pytest

from tonearm.session import session
from tonearm.sources.adapters import Catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session(8, "tonearm-tests")


@pytest.fixture(scope="session")
def catalogue(spark):
    return Catalogue.of(spark, SMALL)
