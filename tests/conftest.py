import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lotbook.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def listings(spark, sf_dir):
    from checks import views
    from lotbook.session import staged

    return staged(views.listings(spark, sf_dir))


@pytest.fixture(scope="session")
def dirty(spark, sf_dir):
    from checks import views
    from lotbook.session import staged

    return staged(views.listings_dirty(spark, sf_dir))


@pytest.fixture(scope="session")
def signal(spark, sf_dir):
    """Price with a signal, without the columns of many values, to keep fitting short."""
    from checks import views
    from lotbook.session import staged

    rows = views.price_signal(spark, sf_dir).select(
        "listing_id", "price", "make", "body_style", "state", "color", "year", "mileage"
    )
    return staged(rows.repartition(4))
