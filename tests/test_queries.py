import pytest

from plumbline.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")
