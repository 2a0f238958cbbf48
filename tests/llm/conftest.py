import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tests_llm_common import ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """With columns named like those the operators make."""
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "k", 7, [1]) for i, t in ODD]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, names + ", score double, key string, row int, hits array<int>").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
