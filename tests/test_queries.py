"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import pytest

import tessera.plans.catalogue_queries  # noqa: F401
import tessera.plans.cohort_queries  # noqa: F401
import tessera.plans.model_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES
from tests.oracle import connect, differ


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, sf_dir, name):
    assert differ(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11 and set(entry.oracle_sql()) <= set(entry.queries())
