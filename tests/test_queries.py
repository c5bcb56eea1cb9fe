import pytest
from oracle import compare

from gridmill.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, name):
    df = plans.QUERIES[name](spark, small)
    if name in plans.SQL:
        compare(df, plans.SQL[name], small)
    else:
        assert df.count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
