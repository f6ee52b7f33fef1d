import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return FOLDER


@pytest.fixture
def docs(spark):
    """Documents from texts, with columns whose names the operators use themselves."""

    def make(texts, ids=None):
        rows = [(k if ids is None else ids[k], t, "x", "y", 1, None, "z") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, _text string, row string, n_lines int, key string, class_id string").repartition(3)

    return make
