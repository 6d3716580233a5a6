import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quern.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def frame(spark, rows, schema):
    """A DataFrame from rows, empty ones too."""
    return spark.createDataFrame(rows, schema)


SF = "/root/testdata/sf0.001"
