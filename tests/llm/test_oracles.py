"""The SQL of the operators that have one."""

import pytest
from helpers import assert_same, duck

from tessella.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLE_SQL[name])
