import pytest
from oracle import compare

from pixelloom.plans import media_oracle, media_queries


@pytest.mark.parametrize("name", sorted(media_queries.queries()))
def test_query_equals_sql(spark, name):
    assert compare(spark, media_queries.queries()[name], media_oracle.oracle_sql()[name], "/root/testdata/sf0.01") > 0
