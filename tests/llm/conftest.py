"""Small frames for the operators' tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture
def documents(spark):
    """Builds a documents frame from texts, or from (doc_id, text, ...) rows."""

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            full.append((*row, *(None, "src", None)[len(row) - 2 :]))
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint"
        )

    return build
