import os

import pytest

from lendlens.llm.common import importable, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers_can_import(spark):
    importable(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SMALL, "documents").cache()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def tokenizer_file():
    from lendlens.llm.queries import tokenizer_path

    path = tokenizer_path()
    if not os.path.exists(path):
        pytest.skip("no tokenizer files here")
    return path
