"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
import check
from marketframe.plans import CATALOG

SQL = entry.oracle_sql()
# fits that only add up rows: run by check.py on the larger tables
SLOW = {"m8_regression_importance", "m9_classification_importance", "m10_classifier", "m10_training_flow", "m11_grid_search", "m15_future_class"}


@pytest.fixture(scope="module")
def con(small):
    return check.duck(small)


@pytest.mark.parametrize("name", [n for n in CATALOG if n not in SLOW])
def test_query(spark, small, con, name):
    result = check.compare(spark, con, entry.queries()[name], SQL.get(name), small)
    assert not result.startswith("FAIL"), result


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["symbol", "date"]
    assert df.count() > 0
