"""Training-data queries against their SQL."""

import pytest

from factspan.llm import catalogue
from tests.oracles import agree, connect

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    agree(spark, connect(DIR), DIR, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.QUERIES) == list(range(1, 14))
