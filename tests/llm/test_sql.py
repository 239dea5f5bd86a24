import pytest

from quernstone.llm.queries import ORACLE_SQL, QUERIES

from .oracle import oracle, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == oracle(SF, ORACLE_SQL[name])
