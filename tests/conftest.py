import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablediff.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8)
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tablediff-test-")


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)
