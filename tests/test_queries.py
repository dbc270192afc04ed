import os

import pytest

from juriloom.plans import registry

from oracle import both

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    ours, theirs = both(spark, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert ours == theirs
    assert ours or name == "q09_unsafe_year" or theirs == []


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_file_has_all(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
