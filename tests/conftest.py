import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wakeline.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def reports(spark):
    from verification.ais_view import ais

    return ais(spark, SMALL).cache()


def position(spark, rows):
    """Reports from partial dicts; missing fields are null."""
    from wakeline.schema import POSITION

    names = [f.name for f in POSITION.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], POSITION)
