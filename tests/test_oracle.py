"""Every query with SQL gives the rows DuckDB gives."""

import pytest

from check_oracle import compare, connect
from groundcheck.plans.catalog import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"

#: Full fits of minutes. tests/test_models.py has the same code in small sizes; ``check_oracle.py`` runs these with all others.
SLOW = {"train_and_compare", "gradient_boosting", "param_sweep"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_matches_sql(spark, con, name):
    verdict = compare(spark, con, QUERIES[name], ORACLE[name], SF_DIR)
    assert verdict.startswith("ok"), verdict
    assert "types" not in verdict, verdict


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 6
