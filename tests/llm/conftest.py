import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def edge_docs(spark):
    from brute import DOC_SCHEMA, edge_documents

    return spark.createDataFrame(edge_documents(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    from brute import DOC_SCHEMA

    return spark.createDataFrame([], DOC_SCHEMA)
