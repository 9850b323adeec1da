"""Every registered query against its SQL oracle, on the smallest tables."""

import re

import pytest
from check import compare, connect

from __spark_entry__ import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    own = {q for q in QUERIES if not re.match(r"op\d+_|pipeline$", q)}  # the text queries are tested apart
    assert own == set(ORACLES) & own


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    problem, _rows = compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name])
    assert problem is None, problem
