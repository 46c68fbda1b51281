import pytest

from pinweave.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_its_sql(compare, name):
    compare(name)


def test_flagship_is_balanced(spark):
    sizes = [r["count"] for r in catalogue.flagship(spark, "/root/testdata/sf0.001").groupBy("part").count().collect()]
    assert sum(sizes) == 200 and len(sizes) == 4 and max(sizes) <= 52
