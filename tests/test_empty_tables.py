"""Every library query runs on tables without rows."""

import pyarrow.parquet as pq
import pytest

from tracelake.plans import further_queries, more_queries  # noqa: F401
from tracelake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Whole-table summaries have one row whatever they count; a limit that is searched among groups needs one.
ONE_ROW = {"key_cardinalities", "rectilinear", "paired_comparison", "responder_totals", "stat_table", "counts_with_totals", "repeated_values"}


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in "customer orders lineitem part supplier events documents embeddings pages".split():
        pq.write_table(pq.read_table(f"{SF}/{t}.parquet").slice(0, 0), f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() <= (3 if name == "repeated_values" else 1 if name in ONE_ROW else 0)
