import pytest
from compare import connect, rows

from skein.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_is_repeatable(spark, name):
    first, again = (rows(catalog.queries()[name](spark, SF).toPandas()) for _ in range(2))
    assert first and first == again
