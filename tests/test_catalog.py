import itertools

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refloom.functions.similarity import indel_ratio, lcs_length
from refloom.operators.evaluate import assignment
from refloom.plans import catalog
from verify import compare, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        assert df.count() > 0
        return
    con = duckdb.connect()
    views(con, SF)
    assert compare(df, con, catalog.ORACLE_SQL[name]) == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), min_size=4, max_size=4), min_size=1, max_size=5))
def test_assignment_is_optimal(rows):
    cost = np.array(rows, float)
    pairs = assignment(cost)
    n, m = cost.shape
    small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
    best = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))
    assert len(pairs) == min(n, m) and sum(cost[i, j] for i, j in pairs) == best


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs_length(a, b) == table[-1][-1]
    assert indel_ratio("", "") == 100 and indel_ratio(a, a) == 100
