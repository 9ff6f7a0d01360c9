import pytest


@pytest.fixture(scope="session", autouse=True)
def _package_on_workers(spark):
    from fleetlens.session import ship_package

    ship_package(spark)
