"""Every registered graph query against DuckDB over the same tables."""

from collections import Counter

import pytest
from skein.plans import oracles, queries

QUERIES, ORACLES = queries.queries(), oracles.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(found.fetchall())
