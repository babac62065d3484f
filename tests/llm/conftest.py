import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from benchscope.session import local_session
    s = local_session(cores=4, shuffle_partitions=4)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="benchscope-llm-"))
    return s


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture()
def frame(spark):
    """(doc_id, text, and a column named like an operator's own) from pairs; ids or texts may be None."""
    def make(pairs):
        return spark.createDataFrame([(i, t, 7, "x") for i, t in pairs], "doc_id long, text string, count int, node string")
    return make
