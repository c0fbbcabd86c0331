"""Every query against its SQL counterpart, on all rows of the small tables."""

import compare
import pytest

import __spark_entry__ as repo
import inspections

SF_DIR = "/root/testdata/sf0.001"
ORACLES = inspections.ORACLES


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(inspections.QUERIES))
def test_query(spark, con, key):
    df = repo.queries()[key](spark, SF_DIR)
    if key in ORACLES:
        assert compare.differences(df, con, ORACLES[key]) is None
    else:
        assert df.count() > 0


def test_only_file_queries_go_without_sql():
    assert set(inspections.QUERIES) - set(ORACLES) == {"ck_file_size", "ck_file_format"}


def test_entry_has_the_result_schema(spark):
    from tablewarden import RESULT_SCHEMA

    df = repo.entry(spark)
    assert df.columns == RESULT_SCHEMA.fieldNames()
    assert df.count() == 21
