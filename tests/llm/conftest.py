import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import ODD_TEXTS, SF  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with ours."""
    rows = [
        (i if i != 3 else None, t, "en" if i % 3 else None, "src", len(t or ""), f"row{i}", 1, True)
        for i, t in enumerate(ODD_TEXTS)
    ]
    rows.append(rows[-1])
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, kept int, first boolean")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
