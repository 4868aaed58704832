import pytest
from check_oracle import compare

from wirelog.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    verdict, _, fine = compare(spark, "/root/testdata/sf0.001", name, QUERIES[name], ORACLES[name])
    assert fine, verdict
