import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from conftest_llm import TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1, True, "k", 2.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, kept boolean, key string, score double")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
