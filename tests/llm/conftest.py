import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_rows import SCHEMA, doc_rows  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(doc_rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs():
    """(doc_id, text) of the documents."""
    return [(r[0], r[1]) for r in doc_rows()]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from storelake.llm.common import ship_package
    ship_package(spark)
