import pytest
from conftest import same

from granary import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, data, duck, name):
    out = plans.QUERIES[name](spark, data)
    if name in plans.ORACLE_SQL:
        assert same(out, duck.execute(plans.ORACLE_SQL[name]))
    else:
        assert out.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
