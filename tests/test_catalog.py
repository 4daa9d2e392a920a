import pytest
from quarry.plans import catalog

from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    if name in catalog.oracle_sql():
        oracle.check(df, catalog.oracle_sql()[name], SF)
    else:
        assert df.count() > 0
