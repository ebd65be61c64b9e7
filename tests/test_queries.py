import pytest

from skiff.plans import queries as engine
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, engine.queries()[name], engine.oracle_sql()[name], SF)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
