"""Every registered query runs over an empty table and over awkward rows, and returns a row for each document."""

import pytest

from lethe.llm import queries

from .cases import frame, write_tables

LABELS = [(1, 1, 0), (3, 1, 0), (9, 1, 0), (10, 1, None), (12, 0, 1), (6, 0, 1), (None, 1, 1), (7, None, 0)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full = write_tables(spark, tmp_path_factory.mktemp("full"), frame(spark, clash=True).coalesce(1), LABELS)
    empty = write_tables(spark, tmp_path_factory.mktemp("empty"), frame(spark, []), [])
    return full, empty


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - {"op13_centroids"}))  # that reads no documents
def test_awkward_rows_and_empty_tables(spark, folders, name):
    full, empty = folders
    out = queries.QUERIES[name](spark, full)
    assert "doc_id" in out.columns
    assert out.count() == 14
    again = queries.QUERIES[name](spark, empty)
    assert again.columns == out.columns
    assert again.count() == 0
