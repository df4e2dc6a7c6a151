import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, digest int, spans string, row int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [
        (1, None, "en", 1, "a", 1), (2, "", "en", 1, "a", 1), (3, "  \n ", "de", 1, None, 1), (None, "a b", None, 1, "a", 1),
        (4, long, "en", 1, "a", 1), (4, long, "en", 1, "a", 1), (None, None, None, None, None, None), (5, "Ünï çödé", "de", 1, "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)
