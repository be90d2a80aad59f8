"""The queries against their SQL, and that every query has one or a plain version to be held against."""

import pytest

from shiftwise.llm.queries import ORACLE, QUERIES
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name])


def test_queries_without_sql():
    # tokenizers, crc32 and approximate search are beyond SQL; see the tests of each
    assert {n.split("_")[0] for n in set(QUERIES) - set(ORACLE)} == {"op2", "op5", "op6", "op8", "op10", "op11", "op13"}
